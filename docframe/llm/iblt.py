"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame expressions only.

A text's paragraphs are its lines, long ones in parts of WORDS words. Each distinct paragraph's digest
is added to one cell in each of the three blocks of a sketch; a cell holds a count, the XOR of the
digests and the XOR of their check hashes. Subtracting two sketches of one size leaves what differs. Peeling takes
digests from cells that hold exactly one until none is left.

A document's fingerprint is its sketch in the least size that has room for twice its paragraphs and
peels to all of them, larger ones being tried where it doesn't. So a fingerprint can be read back, and
sketched again in the size of a larger one that it is to be subtracted from; a difference that doesn't peel
is retried in the next larger size. Likeness is a function of two fingerprints alone: what is common to both over
what is in either.

Cells are rows, grouped by document and place. The table of digests is bucketed by document, so
grouping and peeling need no shuffle, whatever the size of a sketch.
"""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import inputs
from docframe.session import cut, scratch_dir

WORDS = 24
#: Cells a paragraph of two versions, cells besides, and least cells of a block.
ROOM, SPARE, SIDE = 1.4, 12, 16
#: Rounds of peeling, each over one of the three blocks.
ROUNDS = 15
#: Documents of a range bucket on average, and buckets at most; characters and documents of a part of the digests' table, and parts at most.
BUCKET_DOCS, BUCKETS = 500, 65_536
PART_CHARS, PART_DOCS, PARTS = 8_000_000, 4_000, 100_000
#: What a sketch is of: a text, its edited text, and their differences from each other and of a text from the next one.
TEXT, EDITED, FROM_EDITED, FROM_NEXT = range(4)


def paragraphs(text: str) -> str:
    """SQL for the distinct paragraph digests of a text; none for an empty text."""
    return f"array_distinct(transform(regexp_extract_all({text}, '(?:[^ \\\\n]++ *+){{1,{WORDS}}}+', 0), x -> xxhash64(rtrim(x))))"


def check(k: str) -> str:
    return f"xxhash64({k}, 77)"


def bits_for(n: str) -> str:
    """SQL for the binary logarithm of a block's cells in the sketch of ``n`` paragraphs."""
    return f"cast(ceil(log2(greatest({SIDE}D, (2 * {ROOM}D * {n} + {SPARE}) / 3))) as int)"


def _cell(block: int, k: str, bits: str) -> str:
    return f"{block} * shiftleft(1L, {bits}) + (xxhash64({k}, {block}) & (shiftleft(1L, {bits}) - 1))"


def _entries(kinds: list[tuple[int, int, str]], k: str) -> str:
    """SQL for what a digest adds to the sketches (kind, sign, bits): one entry a block. ``g`` is kind and bits in one."""
    each = (f"named_struct('g', {kind} + 4 * {bits}, 'i', {_cell(b, k, bits)}, 'n', {sign}L, 'k', {k}, 'c', {check(k)})" for kind, sign, bits in kinds for b in range(3))
    return f"array({', '.join(each)})"


def summed(entries: DataFrame) -> DataFrame:
    """The cells (rid, g, i: n, k, c) of entries; what cancels is left out. Cell -1 counts the digests that were found."""
    cells = entries.groupBy("rid", "g", "i").agg(F.sum("n").alias("n"), F.expr("bit_xor(k)").alias("k"), F.expr("bit_xor(c)").alias("c"))
    return cells.where("i < 0 or n <> 0 or k <> 0 or c <> 0")


def peeled(cells: DataFrame) -> DataFrame:
    """``rid, g, found, left``: how many digests peeling takes from each sketch, and how many cells remain if it fails.

    A round takes those of one block, where no digest is in two cells, from the cells of the other two."""
    for r in range(ROUNDS):
        own, (x, y) = r % 3, [b for b in range(3) if b != r % 3]
        bits = "shiftright(g, 2)"
        pure = f"i >= 0 and shiftright(i, {bits}) = {own} and abs(n) = 1 and c = {check('k')}"
        less = (f"named_struct('i', {_cell(b, 'k', bits)}, 'n', -n, 'k', k, 'c', c)" for b in (x, y))
        taken = f"array(named_struct('i', -1L, 'n', 1L, 'k', 0L, 'c', 0L), {', '.join(less)})"
        cells = summed(cells.select("rid", "g", F.expr(f"inline(if({pure}, {taken}, array(named_struct('i', i, 'n', n, 'k', k, 'c', c))))")))
    return cells.groupBy("rid", "g").agg(F.sum(F.expr("if(i < 0, n, 0L)")).alias("found"), F.count_if(F.col("i") >= 0).alias("left"))


def _marks(kinds: list[tuple[int, str]]) -> str:
    """SQL for an empty count of each sketch, so that one without paragraphs has a row too."""
    return ", ".join(f"named_struct('v', -1, 'k', cast({kind} + 4 * {bits} as bigint))" for kind, bits in kinds)


def first_try(base: DataFrame) -> DataFrame:
    """``rid, g, found, left`` of all four sketches of each row of ``base`` (rid, a, e, x: digests), each in the size that the larger of
    its versions asks for."""
    sized = base.selectExpr("rid", "a", "e", "x", f"{bits_for('size(a)')} as ba", f"{bits_for('size(e)')} as be", f"{bits_for('greatest(size(a), size(e))')} as bd", f"{bits_for('greatest(size(a), size(x))')} as bn")
    versions = ", ".join(f"transform({v}, d -> named_struct('v', {i}, 'k', d))" for i, v in enumerate("aex"))
    marks = _marks([(TEXT, "ba"), (EDITED, "be"), (FROM_EDITED, "bd"), (FROM_NEXT, "bn")])
    rows = sized.select("rid", "ba", "be", "bd", "bn", F.expr(f"inline(concat({versions}, array({marks})))"))
    mine = {
        0: [(TEXT, 1, "ba"), (FROM_EDITED, 1, "bd"), (FROM_NEXT, 1, "bn")],
        1: [(EDITED, 1, "be"), (FROM_EDITED, -1, "bd")],
        2: [(FROM_NEXT, -1, "bn")],
    }
    cases = " ".join(f"when v = {v} then {_entries(kinds, 'k')}" for v, kinds in mine.items())
    mark = "array(named_struct('g', cast(k as int), 'i', -1L, 'n', 0L, 'k', 0L, 'c', 0L))"
    return peeled(summed(rows.select("rid", F.expr(f"inline(case {cases} else {mark} end)"))))


def retried(failed: DataFrame) -> DataFrame:
    """``rid, g, found`` of sketches (rid, g, plus, minus: digests) that didn't peel, each in the least larger size that does."""
    done, attempt = None, 1
    while True:
        bits = f"(shiftright(g, 2) + {attempt})"
        rows = failed.select("rid", "g", F.expr("inline(concat(transform(plus, d -> named_struct('v', 1L, 'k', d)), transform(minus, d -> named_struct('v', -1L, 'k', d)), array(named_struct('v', 0L, 'k', 0L))))"))
        entries = ", ".join(f"named_struct('i', {_cell(b, 'k', bits)}, 'n', v, 'k', k, 'c', {check('k')})" for b in range(3))
        cells = rows.select("rid", F.expr(f"g + {4 * attempt} as g"), F.expr(f"inline(if(v = 0, array(named_struct('i', -1L, 'n', 0L, 'k', 0L, 'c', 0L)), array({entries})))"))
        out = cut(peeled(summed(cells)))
        good = out.where("left = 0").select("rid", "g", "found")
        done = good if done is None else done.union(good)
        bad = out.where("left > 0").select("rid", F.expr(f"g - {4 * attempt} as g"))
        if not bad.limit(1).count():
            return done
        failed, attempt = cut(failed.join(bad, ["rid", "g"], "left_semi")), attempt + 1


def as_text(v: int) -> Column:
    """The sketch of version ``v`` as its block's size and base64 of place (4 bytes), count (4), digests (8) and check (8) of each cell in use."""
    cells = F.unhex(F.array_join(F.array_sort(F.collect_list(F.when(F.col("v") == v, F.col("cell")))), ""))
    bits = F.max(F.when(F.col("v") == v, F.expr("shiftright(g, 2)")))
    return F.concat(bits.cast("string"), F.lit(":"), F.regexp_replace(F.base64(cells), "\\s", ""))


def _bounds(rows: DataFrame, n: int) -> list[tuple[int, float]]:
    """Where the ranges of ``rows`` (key, h) begin, as keys and hashes of rows. -1 stands for a key's first row; a key that fills
    more than one range is parted by hash."""
    parts = int(min(BUCKETS, max(1, n // BUCKET_DOCS)))
    marks = rows.agg(F.percentile_approx("key", [i / parts for i in range(parts)], 20 * parts)).first()[0] if n else None
    times = Counter(marks or [0])
    most = max(times.values())
    hot = [k for k, c in times.items() if c > 1]
    out = [(k, -1.0) for k in times if k not in set(hot)]
    if hot:
        cuts = [i / most for i in range(most)]
        for key, least, found in rows.where(F.col("key").isin(hot)).groupBy("key").agg(F.min("h"), F.percentile_approx("h", cuts, 20 * most)).collect():
            out += [(key, h) for h in {least, *found}]
    return sorted(out)


def _in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, text, digests`` with the text and digests of the next row by doc_id (and the text's hash, and text), the
    first one's after the last; and the number of parts that the rows should be dealt to.

    Buckets are ranges that begin at rows. Every bucket also gets the rows that may
    open the next one, so that one shuffle puts each row next to its successor."""
    rows = inputs(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.selectExpr("doc_id", "text", "coalesce(doc_id, -9223372036854775808L) as key", "shiftrightunsigned(xxhash64(text), 1) / 9223372036854775808D as h")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    bounds = _bounds(rows, n)
    least = rows.agg(F.min("key")).first()[0]
    if least is not None and least < bounds[0][0]:
        bounds[0] = (least, -1.0)
    steps, m = max(1, (len(bounds) - 1).bit_length()), len(bounds)
    keys, hashes = F.from_json(F.lit(str([k for k, _ in bounds])), "array<long>"), F.from_json(F.lit(str([h for _, h in bounds])), "array<double>")
    rows = rows.withColumn("ks", keys).withColumn("hs", hashes)
    # The last bound that isn't above the row, bit by bit.
    past = "ks[{0}] < key or (ks[{0}] = key and hs[{0}] <= h)".format("at + shiftleft(1, s)")
    found = f"aggregate(sequence({steps - 1}, 0, -1), 0, (at, s) -> if(at + shiftleft(1, s) < {m}, if({past}, at + shiftleft(1, s), at), at))"
    rows = rows.withColumn("bucket", F.expr(found))
    opens = "key = ks[bucket] and (hs[bucket] < 0 or hs[bucket] = h)"
    spots = f"if({opens}, array(named_struct('bucket', bucket, 'guest', false), named_struct('bucket', (bucket + {m - 1}) % {m}, 'guest', true)), array(named_struct('bucket', bucket, 'guest', false)))"
    rows = rows.select("doc_id", "text", "h", F.expr(paragraphs("text")).alias("digests"), F.expr(f"inline({spots})"))
    window = "over (partition by bucket order by guest, doc_id, h, text)"
    parts = int(min(PARTS, max(1, n // PART_DOCS, chars // PART_CHARS)))
    return rows.selectExpr("*", f"lead(text) {window} as next_text", f"lead(digests) {window} as next_digests").where("not guest"), parts


def _base(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, n_chars, edited_sha256, a, e, x`` of every row: the digests of its text, its edited text and the next one,
    as a table bucketed by rid in the shared folder."""
    rows, parts = _in_order(docs)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))")
    rows = rows.withColumn("edited", edited).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"),
        F.col("digests").alias("a"), F.expr(paragraphs("edited")).alias("e"), F.col("next_digests").alias("x"),
    )
    name = f"docframe_digests_{uuid.uuid4().hex}"
    path = f"{scratch_dir(docs.sparkSession)}/cut-{name}"
    rows.repartition(parts, "rid").write.bucketBy(parts, "rid").option("path", path).saveAsTable(name)
    return docs.sparkSession.table(name)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row of ``docs``
    (doc_id, text).

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones of the
    next document, by ascending doc_id, the first one after the last. Likeness is common over all
    paragraphs, from the two fingerprints; two versions without paragraphs are alike (1). A null text
    counts as empty. Rows of one doc_id follow each other by a hash of their text, rows without one come first, and repeated
    rows have a row each. An empty table gives no rows, other columns are ignored."""
    base = _base(docs)
    tried = first_try(base).groupBy("rid").agg(
        *(F.max(F.when(F.expr(f"(g & 3) = {kind} and left = 0"), F.col("found"))).alias(f"d{kind}") for kind in range(4)),
        *(F.max(F.when(F.expr(f"(g & 3) = {kind}"), F.col("g"))).alias(f"g{kind}") for kind in range(4)),
    )
    failed = "d0 is null or d1 is null or d2 is null or d3 is null"
    first = cut(base.join(tried, "rid").select("rid", *(f"{c}{kind}" for c in "dg" for kind in range(4)), *(F.expr(f"if({failed}, {v}, null)").alias(v) for v in "aex")))
    again = ", ".join(f"named_struct('d', d{kind}, 'g', g{kind}, 'plus', {plus}, 'minus', {minus})" for kind, plus, minus in ((0, "a", "array()"), (1, "e", "array()"), (2, "a", "e"), (3, "a", "x")))
    again = again.replace("array()", "cast(array() as array<bigint>)")
    open_ones = first.where(failed).select("rid", F.expr(f"inline(array({again}))")).where("d is null").select("rid", "g", "plus", "minus")
    late = retried(open_ones).groupBy("rid").agg(
        *(F.max(F.when(F.expr(f"(g & 3) = {kind}"), F.col("found"))).alias(f"l{kind}") for kind in range(4)),
        *(F.max(F.when(F.expr(f"(g & 3) = {kind}"), F.col("g"))).alias(f"h{kind}") for kind in range(2)),
    )
    near = "coalesce(try_divide(n0 + n{0} - {1}, cast(n0 + n{0} + {1} as double)), 1D)"
    counts = [f"coalesce(d{kind}, l{kind}) as {'n' if kind < 2 else 'm'}{kind}" for kind in range(4)]
    facts = first.select("rid", *(f"{c}{kind}" for c in "dg" for kind in range(4))).join(late, "rid", "left").selectExpr("rid", *counts, *(f"coalesce(h{kind}, g{kind}) as g{kind}" for kind in range(2)))
    known = base.join(facts, "rid")
    sizes = known.select("rid", "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "n0", "n1", "m2", "m3", F.expr("cast(size(x) as bigint) as nx"))
    versions = "concat(transform(a, d -> named_struct('g', g0, 'k', d)), transform(e, d -> named_struct('g', g1, 'k', d)), array(named_struct('g', g0, 'k', cast(null as bigint)), named_struct('g', g1, 'k', cast(null as bigint))))"
    rows = known.select("rid", F.expr(f"inline({versions})"))
    entries = ", ".join(f"named_struct('i', {_cell(b, 'k', 'shiftright(g, 2)')}, 'n', 1L, 'k', k, 'c', {check('k')})" for b in range(3))
    cells = summed(rows.select("rid", "g", F.expr(f"inline(if(k is null, array(named_struct('i', -1L, 'n', 0L, 'k', 0L, 'c', 0L)), array({entries})))")))
    cell = "if(i < 0, '', concat(lpad(hex(i), 8, '0'), lpad(hex(n), 8, '0'), lpad(hex(k), 16, '0'), lpad(hex(c), 16, '0')))"
    texts = cells.select("rid", "g", F.expr("g & 3 as v"), F.expr(f"{cell} as cell")).groupBy("rid").agg(as_text(TEXT).alias("fingerprint"), as_text(EDITED).alias("edited_fingerprint"))
    return sizes.join(texts, "rid").selectExpr(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", f"{near.format(1, 'm2')} as near_edited", f"{near.format('x', 'm3')} as near_next"
    )

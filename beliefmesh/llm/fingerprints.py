"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs, with DataFrame functions only.

A paragraph is a line, cut into pieces of at most 128 code points; its digest is xxhash64. A sketch has three parts of
equal size; a digest is added to one cell of each part, and a cell holds the number of digests added and the xor of
the digests and of their checks. Sketches subtract cell by cell; a cell of the difference with one digest (the check
tells) yields it, and taking it out of its other cells frees more, until the difference is empty: the digests that only
one version has. If cells are left, larger sketches are tried, three times as large each time; at last the digest sets
themselves are compared, so the result is always exact.

The fingerprint is the smallest sketch of the whole text, in hex. Retries work on slices of the digests, so that the
work on a long text stays about proportional to its length: digests are dealt by their value into as many slices as
make 8 a slice, and each slice is subtracted and peeled by itself.

likeness(a, b) = common / (common + differing) digests: their Jaccard coefficient, 1 for two empty sets.

The next document, in ascending (doc_id, hash of text) order, is found in slices of the id range: rows are dealt by
slices between approximate quantiles of the id (bounded number), a window leads within a slice, and the first row of
each slice is joined to the last row of the slice before it. Text is shuffled once.

Defined cases: null text is empty text; null ids come first; repeated rows follow each other, as next documents of one
another; ties of the id go by the hash of the text; one row alone is its own next document; a very long text is one row;
an empty table gives an empty result; other columns, also ones such as `fingerprint`, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beliefmesh.llm.common import pick

PIECE = 128
PART = 4  # cells in each of the three parts of the fingerprint
SLICE = 8  # digests in a slice of a retry
RETRY_PARTS = (8, 24)
SLICES_OF_IDS = 1024


def digests(text: str) -> str:
    """SQL: the sorted distinct digests of a text's paragraphs."""
    return f"array_sort(array_distinct(transform(regexp_extract_all({text}, '[^\\\\n]{{1,{PIECE}}}', 0), p -> xxhash64(p))))"


def spots(d: str, part: int) -> str:
    """SQL: the three cells of a digest, disjoint by part."""
    return f"array(cast(pmod({d}, {part}) as int), cast({part} + pmod(shiftright({d}, 21), {part}) as int), cast({2 * part} + pmod(shiftright({d}, 42), {part}) as int))"


def sketch(digest_array: str, part: int) -> str:
    """SQL: the cells (c, k, h) of a sketch: count, xor of digests, xor of their checks."""
    placed = f"transform({digest_array}, d -> named_struct('d', d, 'h', xxhash64(d, 17), 'at', {spots('d', part)}))"
    # the digests are placed once, in a one-element array, and read by every cell
    return f"""flatten(transform(array({placed}), ps -> transform(sequence(0, {3 * part - 1}), i -> aggregate(filter(ps, p -> p.at[i div {part}] = i),
        named_struct('c', 0L, 'k', 0L, 'h', 0L),
        (a, p) -> named_struct('c', a.c + 1L, 'k', a.k ^ p.d, 'h', a.h ^ p.h)))))"""


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def peel(cells: str, part: int, rounds: int = 12) -> str:
    """SQL: the digests that differ, null if cells are left. All pure cells of a round are taken out together."""
    pure = "array_distinct(transform(filter(s.cells, c -> abs(c.c) = 1 and c.h = xxhash64(c.k, 17)), c -> named_struct('d', c.k, 'c', c.c)))"
    placed = f"transform({pure}, p -> named_struct('d', p.d, 'c', p.c, 'h', xxhash64(p.d, 17), 'at', {spots('p.d', part)}))"
    step = f"""aggregate(array({placed}), s, (t, ps) -> if(size(ps) = 0, named_struct('cells', t.cells, 'found', t.found, 'go', false), named_struct(
        'cells', transform(t.cells, (c, i) -> if(c.c = 0 and c.h = 0, c, aggregate(filter(ps, p -> p.at[i div {part}] = i), c, (a, p) -> named_struct('c', a.c - p.c, 'k', a.k ^ p.d, 'h', a.h ^ p.h)))),
        'found', concat(t.found, transform(ps, p -> p.d)), 'go', true)))"""
    return f"""aggregate(sequence(1, {rounds}), named_struct('cells', {cells}, 'found', cast(array() as array<bigint>), 'go', true),
        (s, r) -> if(s.go, {step}, s),
        s -> if(forall(s.cells, c -> c.c = 0 and c.k = 0 and c.h = 0), s.found, null))"""


def differing(a: str, b: str, fa: str, fb: str) -> str:
    """SQL: how many digests only one of two texts has. a, b: their digests; fa, fb: their fingerprints' cells."""
    first = f"size({peel(subtract(fa, fb), PART)})"
    tries = [f"size({peel(subtract(sketch('two.x', part), sketch('two.y', part)), part)})" for part in RETRY_PARTS]
    exact = "size(array_except(two.x, two.y)) + size(array_except(two.y, two.x))"
    # size(null) is -1 under the default setting and null under ansi: both mean failure
    one = exact
    for t in reversed(tries):
        one = f"aggregate(array({t}), 0, (z, n) -> if(n >= 0, n, {one}))"
    slices = f"greatest(1, cast(ceil(greatest(size({a}), size({b})) / {SLICE}.0) as int))"
    inside = "pmod(shiftright(d, 7) ^ shiftright(d, 50), w)"
    cut = f"""aggregate(array({slices}), 0, (z0, w) -> aggregate(sequence(0, w - 1), 0, (z1, g) -> z1 + aggregate(
        array(named_struct('x', filter({a}, d -> {inside} = g), 'y', filter({b}, d -> {inside} = g))), 0, (z2, two) -> {one})))"""
    return f"aggregate(array({first}), 0, (z, n) -> if(n >= 0, n, {cut}))"


def likeness(a: str, b: str, fa: str, fb: str) -> str:
    d = differing(a, b, fa, fb)
    total = f"size({a}) + size({b})"
    return f"aggregate(array({d}), 0D, (z, n) -> if({total} = 0, 1D, ({total} - n) / cast({total} + n as double)))"


def hexed(cells: str) -> str:
    return f"array_join(transform({cells}, c -> concat(lpad(hex(c.c), 4, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.h), 16, '0'))), '')"


def with_next(docs: DataFrame, slices: int = SLICES_OF_IDS) -> DataFrame:
    """doc_id, text (null: empty), next_text."""
    base = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    bounds = sorted(set(docs.select(F.percentile_approx("doc_id", shares, F.lit(10 * slices)).alias("b")).first()["b"] or []))
    coarse = bounds[::32]
    fine = "array(" + ", ".join(f"{x}L" for x in bounds) + ")" if bounds else "cast(array() as array<bigint>)"
    outer = "array(" + ", ".join(f"{x}L" for x in coarse) + ")" if bounds else "cast(array() as array<bigint>)"
    at = f"aggregate(array(greatest(1, 32 * (size(filter({outer}, b -> b <= doc_id)) - 1) + 1)), 0, (z, s) -> s - 1 + size(filter(slice({fine}, s, 33), b -> b <= doc_id)))"
    dealt = base.withColumn("__s", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.expr(at)))
    order = Window.partitionBy("__s").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    led = dealt.withColumns({"__n": F.row_number().over(order), "next_text": F.lead("text").over(order)})
    firsts = led.where("__n = 1").select(F.col("__s").alias("__from"), F.col("text").alias("first_text"))
    # at most `slices` rows: which slice follows which
    follow = dealt.select("__s").distinct()
    every = Window.partitionBy(F.lit(1)).orderBy("__s")
    follow = follow.select(F.col("__s").alias("__after"), F.coalesce(F.lead("__s").over(every), F.first("__s").over(every)).alias("__from"))
    heads = follow.join(firsts, "__from").select("__after", "first_text")
    joined = led.join(heads, (F.col("__s") == F.col("__after")) & F.col("next_text").isNull(), "left")
    return joined.select("doc_id", "text", F.coalesce("next_text", "first_text").alias("next_text"))


def fingerprints(docs: DataFrame, slices: int = SLICES_OF_IDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    t = with_next(docs, slices).withColumn("n_chars", F.length("text").cast("long"))
    half = "cast(n_chars div 2 as int)"
    t = t.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {half}), substring(next_text, 1, {half}))"))
    t = t.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[F.expr(digests(c)).alias(a) for c, a in (("text", "a"), ("edited", "e"), ("next_text", "x"))])
    t = t.withColumns({f"f{c}": F.expr(sketch(c, PART)) for c in "aex"})
    return t.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(hexed("fa")).alias("fingerprint"), F.expr(hexed("fe")).alias("edited_fingerprint"),
        F.expr(likeness("a", "e", "fa", "fe")).alias("near_edited"), F.expr(likeness("a", "x", "fa", "fx")).alias("near_next"),
    )

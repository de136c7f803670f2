"""Operator 8: document fingerprints from closed syncmers, in DataFrame expressions only.

Every stretch of ``INNER`` code points of the text is hashed. A window of ``K`` code
points holds ``EDGE + 1`` such inner substrings; it is a closed syncmer when the smallest of
their hashes stands at its first or last place. Whether a window is chosen depends
on its own code points only, so equal passages give equal anchors wherever they stand
(context-free), in any script, and an edit touches at most the windows that
hold it. The fingerprint keeps the ``SKETCH`` smallest distinct anchor hashes of the
whole text, each with the position (in code points) where it first stands
(``hash:position``, by hash): a min-wise sample of all anchors. ``likeness`` is the
Jaccard estimate from two samples: the share of the smallest ``SKETCH`` hashes of
the union that both hold. Positions say whether common anchors stand where they
stood.

A text of fewer than ``K`` code points, or without a chosen window, has one anchor:
the hash of the whole text. Defined results: null and empty texts have the empty
fingerprint, which is like itself (1) and unlike any other (0); equal texts have
equal fingerprints.

``edited_pairs`` needs the next document in ascending ``doc_id`` order (null ids
first, ties by text; after the last comes the first). Texts are dealt once, by
ranges of the id between quantiles, and the next one is a ``lead`` inside a range;
only the first document of each range is also sent to the range before. The range
of an id is found in two levels, so a row meets twice the square root of the
number of ranges. The windows of the edited text that lie in its kept part are those of the
text itself; only the rest is scanned again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 12
INNER = 5
#: The last inner substring of a window stands this many code points after the first.
EDGE = K - INNER
SKETCH = 64
#: Documents of one range of ids, and the most ranges (a range of more documents spills).
RANGE_DOCS = 4_000
RANGES = 1 << 16


def _anchors(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """``df`` plus ``<prefix>at`` (starts of the chosen windows, from 0) and ``<prefix>every`` (their hashes).

    The steps are separate columns: an array that a lambda reads is computed
    once per row, not once per element.
    """
    h, at, every = f"{prefix}h", f"{prefix}at", f"{prefix}every"
    inner = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{INNER}}}))."), F.lit(1))
    df = df.withColumn(h, F.transform(inner, lambda s: F.xxhash64(s)))
    get = lambda i: F.get(F.col(h), i)

    def closed(i: Column) -> Column:
        return F.least(get(i), get(i + EDGE)) <= F.least(*[get(i + j) for j in range(1, EDGE)])

    starts = F.sequence(F.lit(0), F.greatest(F.size(h) - (EDGE + 1), F.lit(0)))
    df = df.withColumn(at, F.when(F.size(h) > EDGE, F.filter(starts, closed)).otherwise(F.array().cast("array<int>")))
    # Three inner substrings hold all code points of the window.
    return df.withColumn(every, F.transform(at, lambda i: F.xxhash64(get(i), get(i + EDGE // 2 + 1), get(i + EDGE)))).drop(h)


def _sketch(df: DataFrame, text: str, prefix: str, sketch: int) -> DataFrame:
    """The anchors of ``_anchors`` made to ``<prefix>hashes`` (ascending) and ``<prefix>places``."""
    at, every = f"{prefix}at", f"{prefix}every"
    whole = F.when(F.length(text) > 0, F.array(F.xxhash64(F.col(text)))).otherwise(F.array().cast("array<bigint>"))
    kept = F.slice(F.sort_array(F.array_distinct(every)), 1, sketch)
    df = df.withColumn(f"{prefix}hashes", F.when(F.size(every) > 0, kept).otherwise(whole))
    place = lambda x: F.coalesce(
        F.get(F.col(at), (F.array_position(F.col(every), x) - 1).cast("int")), F.lit(0))
    return df.withColumn(f"{prefix}places", F.transform(f"{prefix}hashes", place))


def with_sketch(df: DataFrame, text: str, prefix: str, sketch: int = SKETCH) -> DataFrame:
    """``df`` plus ``<prefix>hashes`` (ascending) and ``<prefix>places`` of its text's sketch."""
    return _sketch(_anchors(df, text, prefix), text, prefix, sketch).drop(f"{prefix}at", f"{prefix}every")


def as_string(prefix: str) -> Column:
    """The fingerprint as text: ``hash:position`` entries."""
    return F.array_join(F.zip_with(f"{prefix}hashes", f"{prefix}places",
                                   lambda x, p: F.concat(F.lower(F.lpad(F.hex(x), 16, "0")), F.lit(":"), p)), ",")


def likeness(a: str, b: str, sketch: int = SKETCH) -> Column:
    """Jaccard estimate of two hash sketches; two empty ones are alike."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, sketch)
    both = F.size(F.array_intersect(F.array_intersect(union, F.col(a)), F.col(b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def fingerprint(docs: DataFrame, *, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` plus the fingerprint string of each text (an input column of that name is replaced)."""
    names = [c for c in docs.columns if c != out]
    work = docs.select(F.struct(*names).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    done = with_sketch(work, "t", "f_")
    return done.select(*[F.col("row")[n].alias(n) for n in names], as_string("f_").alias(out))


def _ranges(docs: DataFrame) -> Column:
    """The range of a document: how many quantiles of the id are not above it, counted by blocks, then inside one."""
    n = docs.agg(F.count("*")).first()[0]
    count = max(1, min(RANGES, n // RANGE_DOCS))
    if count == 1:
        return F.lit(0)
    points = docs.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)],
                                          max(20_000, 4 * count))).first()[0] or []
    points = sorted(set(points))
    if not points:
        return F.lit(0)
    size = math.isqrt(len(points) - 1) + 1
    blocks = [points[i:i + size] for i in range(0, len(points), size)]
    held = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))
    block = F.greatest(held(F.lit([b[0] for b in blocks])) - 1, F.lit(0))
    inside = held(F.get(F.array(*[F.lit(b) for b in blocks]), block))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(block * size + inside)


def edited_pairs(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: its text, its edited text, the sketches of both and of the next document."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rng = _ranges(base.select("doc_id"))
    rows = base.withColumn("range", rng)

    # First document of each range; the ids decide, a text is looked up for those ids only.
    lows = (rows.groupBy("range").agg(F.min("doc_id").alias("low"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"))
            .withColumn("low", F.when(F.col("nulls") == 0, F.col("low"))))
    # At most RANGES rows of two numbers.
    firsts = (rows.join(F.broadcast(lows.select(F.col("range").alias("r"), "low")),
                        (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("low")))
              .groupBy("range").agg(F.min("text").alias("first_text")))
    # One row per range, at most RANGES: the range before takes the first text of the next one.
    order = Window.orderBy("range")
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = (lows.select("range").withColumn("taker", F.coalesce(F.lag("range").over(order),
                                                                  F.max("range").over(every))))
    after = with_sketch(firsts.join(F.broadcast(before), "range").select("taker", "first_text"), "first_text", "first_")

    w = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    half = F.floor(F.length("text") / 2).cast("int")
    led = (rows.withColumn("lead_text", F.lead("text").over(w))
           .join(after, F.col("range") == F.col("taker"), "left")
           .withColumn("kept", F.length("text") - half)
           .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("kept")),
                                          F.substring(F.coalesce("lead_text", "first_text"), F.lit(1), half)))
           .drop("lead_text", "first_text", "first_places"))
    # Windows of the edited text: those that end in the kept part are the text's own, the rest stand in ``tail``.
    own = _sketch(_anchors(led, "text", "own_"), "text", "own_", SKETCH)
    rest = F.greatest(F.col("kept") - (K - 1), F.lit(0))
    both = _anchors(own.withColumn("rest", rest).withColumn("tail", F.expr("substring(edited, rest + 1)")), "tail", "t_")
    same = F.size(F.filter("own_at", lambda i: i < F.col("rest")))
    both = (both.withColumn("e_at", F.concat(F.slice("own_at", F.lit(1), same),
                                             F.transform("t_at", lambda i: i + F.col("rest"))))
            .withColumn("e_every", F.concat(F.slice("own_every", F.lit(1), same), "t_every")))
    both = _sketch(both, "edited", "e_", SKETCH)
    both = both.select("doc_id", "text", "range", "edited", "own_hashes", "own_places", "e_hashes", "e_places", "first_hashes")
    return both.withColumn("next_hashes", F.coalesce(F.lead("own_hashes").over(w), "first_hashes")).drop("range", "first_hashes")


def edit_likeness(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness.

    The edited text: the last ``floor(n / 2)`` code points give way to the first as
    many (or all) of the next document. ``same_place`` is the share of the anchors
    common with the edited text that keep their position.
    """
    p = edited_pairs(docs, text=text, doc_id=doc_id)
    common = F.size(F.array_intersect("own_hashes", "e_hashes"))
    pairs = lambda x: F.zip_with(f"{x}_hashes", f"{x}_places", lambda a, b: F.struct(a.alias("h"), b.alias("p")))
    kept = F.size(F.array_intersect(pairs("own"), pairs("e")))
    return p.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                    F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    as_string("own_").alias("fingerprint"), as_string("e_").alias("edited_fingerprint"),
                    likeness("own_hashes", "e_hashes").alias("near_edited"),
                    likeness("own_hashes", "next_hashes").alias("near_next"),
                    F.when(common > 0, kept / common).alias("same_place"))

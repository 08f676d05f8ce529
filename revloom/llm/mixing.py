"""Mixing sources to target weights by Pfair scheduling, with SQL functions only.

Documents of a source are cut into blocks of ``block_rows``. A source with weight k of D gets k blocks in
every D slots; its block j of a period may not start before slot floor(j D / k) and must be placed by slot
ceil((j + 1) D / k). Earliest deadline first among the released blocks meets all deadlines, so at every
slot each source is less than one block away from its share.

Weights are whole parts of ``resolution``, hence the pattern repeats every D slots: it is worked out once per
phase and repeated by arithmetic, whatever the number of blocks. A phase ends when a source runs out; the
others go on with their weights among themselves, so every document is placed.

The pattern is folded from one row of all sources (meant for sources that are named by hand, up to some
thousands). Documents are numbered by range partitions, so a hot source is spread.

A null source is the source ``""``. Sources without a weight, or with one that is null or not positive, get
the least weight, one part. Repeated rows and ties are placed one by one, in the order of the hash of
their ``doc_id``; rows without an id come first. Texts are not read. Other columns are ignored.
"""

from pyspark.sql import DataFrame, functions as F

from revloom.plans.order import with_position

BLOCK_ROWS = 100
RESOLUTION = 1000
RUN = 1 << 16


def smoothed_weights(documents: DataFrame, power: float = 0.5) -> DataFrame:
    """(source, weight): the number of documents to a power, which lifts small sources."""
    return documents.groupBy("source").agg(F.pow(F.count(F.lit(1)), F.lit(power)).alias("weight"))


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, in SQL."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _pattern() -> str:
    """Slots of one period: at each the released source with the earliest deadline.

    ``kk`` holds the parts of each source (0: exhausted), ``d`` their sum.
    """
    ready = ("filter(transform(kk, (k, i) -> IF(k > 0 AND a.c[i] * d < (t + 1) * k, "
             "named_struct('due', ((a.c[i] + 1) * d + k - 1) DIV k, 'i', CAST(i AS BIGINT)), NULL)), "
             "e -> e IS NOT NULL)")
    step = _let("pick", f"array_min({ready}).i",
                "named_struct('c', transform(a.c, (v, i) -> IF(CAST(i AS BIGINT) = pick, v + 1L, v)), "
                "'t', concat(a.t, array(pick)))")
    return ("aggregate(sequence(0L, d - 1L), named_struct('c', transform(kk, k -> 0L), "
            f"'t', CAST(array() AS ARRAY<BIGINT>)), (a, t) -> {step}, a -> a.t)")


def _phases() -> str:
    """All phases of the array ``s`` of (src, n, k) as an array of structs."""
    last = ("array_min(filter(transform(kk, (k, i) -> IF(k > 0, ((st.left[i] - 1) DIV k) * d + "
            "element_at(filter(sequence(0L, d - 1L), x -> slots[CAST(x AS INT)] = CAST(i AS BIGINT)), "
            "CAST((st.left[i] - 1) % k AS INT) + 1), NULL)), e -> e IS NOT NULL))")
    served = ("transform(kk, (k, i) -> (length DIV d) * k + CAST(size(filter(slice(slots, 1, "
              "CAST(length % d AS INT)), x -> x = CAST(i AS BIGINT))) AS BIGINT))")
    after = ("named_struct('left', zip_with(st.left, served, (l, v) -> l - v), 'start', st.start + length, "
             "'first', zip_with(st.first, served, (f, v) -> f + v), 'out', concat(st.out, array("
             "named_struct('start', st.start, 'period', d, 'first', st.first, 'served', served, "
             "'parts', kk, 'slots', slots))))")
    body = _let("slots", _pattern(), _let("length", f"{last} + 1L", _let("served", served, after)))
    step = _let("kk", "transform(s, (x, i) -> IF(st.left[i] > 0, x.k, 0L))",
                _let("d", "aggregate(kk, 0L, (u, v) -> u + v)", f"IF(d = 0, st, {body})"))
    kind = ("ARRAY<STRUCT<start: BIGINT, period: BIGINT, first: ARRAY<BIGINT>, served: ARRAY<BIGINT>, "
            "parts: ARRAY<BIGINT>, slots: ARRAY<BIGINT>>>")
    return ("aggregate(sequence(1, size(s)), named_struct('left', transform(s, x -> x.n), 'start', 0L, "
            f"'first', transform(s, x -> 0L), 'out', CAST(array() AS {kind})), (st, p) -> {step}, "
            "st -> st.out)")


def schedule(sources: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """(source, block, slot, release, deadline) for every block of ``sources`` (source, blocks, weight).

    ``release`` and ``deadline`` are slots of the whole order: release <= slot < deadline.
    """
    given = sources.filter("blocks > 0").agg(F.array_sort(F.collect_list(F.struct(
        F.col("source").alias("src"), F.col("blocks").cast("long").alias("n"),
        F.greatest("weight", F.lit(0.0)).alias("w")))).alias("g")).filter(F.size("g") > 0)
    # weights in whole parts of the resolution, one at least
    part = f"greatest(1L, CAST(round(coalesce(x.w, 0.0D) / total * {resolution}) AS BIGINT))"
    row = given.withColumn("total", F.expr(
        "aggregate(g, 0.0D, (t, x) -> t + coalesce(x.w, 0.0D), t -> IF(t > 0, t, 1.0D))")).select(
        F.expr(f"transform(g, x -> named_struct('src', x.src, 'n', x.n, 'k', {part}))").alias("s"))
    phases = row.select("s", F.posexplode(F.expr(_phases())).alias("phase", "o"))
    # blocks that each source has in each phase
    shares = phases.select("phase", F.col("o.start").alias("start"), F.col("o.period").alias("period"), F.posexplode(
        F.arrays_zip(F.col("s.src").alias("src"), F.col("o.first").alias("first"),
                     F.col("o.served").alias("served"), F.col("o.parts").alias("parts"))).alias("i", "e"))
    runs = shares.filter("e.served > 0").select(
        "phase", "start", "period", "i", F.col("e.src").alias("source"), F.col("e.first").alias("first"),
        F.col("e.parts").alias("parts"), (F.col("e.first") + F.col("e.served") - 1).alias("last"))
    # in two steps, so that no row makes an array of all blocks of a source
    cut = runs.select("*", F.explode(F.sequence("first", "last", F.lit(RUN))).alias("from"))
    blocks = cut.select("phase", "start", "period", "i", "source", "first", "parts", F.explode(
        F.sequence(F.col("from"), F.least(F.col("from") + RUN - 1, "last"))).alias("block"))
    slots = phases.select("phase", F.posexplode("o.slots").alias("at", "i"))
    # the m-th slot of a source within the period
    nth = slots.groupBy("phase", "i").agg(F.array_sort(F.collect_list("at")).alias("own")).select(
        "phase", F.col("i").cast("int").alias("i"), F.posexplode("own").alias("m", "at"))
    local = F.col("block") - F.col("first")
    placed = blocks.withColumn("m", (local % F.col("parts")).cast("int")).join(
        nth.hint("merge"), ["phase", "i", "m"])
    whole = F.expr("(block - first) DIV parts * period + start")
    return placed.select(
        "source", "block", (whole + F.col("at")).alias("slot"),
        (whole + F.expr("m * period DIV parts")).alias("release"),
        (whole + F.expr("((m + 1) * period + parts - 1) DIV parts")).alias("deadline"))


def mix(documents: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS,
        resolution: int = RESOLUTION) -> DataFrame:
    """(doc_id, source, block, slot, place, release, deadline) of every document; the mixed order is (slot, place).

    ``weights`` holds (source, weight); by default :func:`smoothed_weights`. Settles the numbered documents
    (ids and sources only) when called.
    """
    source = F.coalesce("source", F.lit("")).alias("source")
    rows = documents.select("doc_id", source)
    given = (smoothed_weights(rows) if weights is None else weights).select(
        source, F.when(F.col("weight") > 0, F.col("weight").cast("double")).alias("weight")).groupBy(
        "source").agg(F.max("weight").alias("weight"))
    sources = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows")).join(given, "source", "left").select(
        "source", F.ceil(F.col("rows") / F.lit(block_rows)).alias("blocks"), "weight")

    numbered = with_position(rows.withColumn("_h", F.xxhash64("doc_id")), ["source"],
                             [F.col("doc_id").isNotNull(), F.col("_h"), F.col("doc_id")])
    at = F.col("position") - 1
    cut = numbered.select("doc_id", "source", F.expr(f"(position - 1) DIV {block_rows}").alias("block"),
                          (at % block_rows).cast("int").alias("place"))
    # blocks grow with the documents, which the planner cannot see: not to be broadcast
    return cut.join(schedule(sources, resolution).hint("merge"), ["source", "block"]).select(
        "doc_id", "source", "block", "slot", "place", "release", "deadline")

"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source with weight w releases its i-th block (from 0) at slot floor(i / w) and must have it out
by slot ceil((i + 1) / w). Earliest deadline first among released blocks keeps every source within
less than one block of its target at every slot. Weights are not rounded: windows run over the
whole time in which the same sources last. When a source ends, the windows of the others begin
anew there, by their weights among themselves.

With a `period`, weights are whole numbers of blocks in each period instead, and deviations from
the unrounded weights add up from period to period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 16
PERIOD_BLOCKS = 100
#: Weights are sizes to this power where none are given: small sources come up more often.
TEMPERATURE = 0.5
#: Slots that are scheduled in one go from the state that a first pass has left at their start.
SEGMENT = 512
#: Parts of a source that are numbered on their own, so that no source is sorted in one task.
PARTS = 1024

# Of sources with blocks left: slots per block by their weights among themselves. Sources of weight
# 0 have none until only such are left, which then share equally.
_SPANS = """
transform(
  array(transform(raw, (w, i) -> if({done}[i] < caps[i], w, 0D))),
  v -> transform(
    array(aggregate(v, 0D, (a, w) -> a + w)),
    total -> if(total > 0,
      transform(v, w -> if(w > 0, total / w, cast(null as double))),
      transform(raw, (w, i) -> if({done}[i] < caps[i],
        aggregate(caps, 0D, (a, c) -> a + 1D), cast(null as double)))))[0])[0]
"""
# A slot's step. State: blocks done by source, those done and the slot when the present windows
# began, slots per block. {slots} hands on what was taken. A source whose next block is not
# released is late-coming and only taken if there is no other, which rounding may bring about.
_STEP = """
transform(
  array(array_min(transform(state.span, (p, i) -> if(p is null, null, named_struct(
    'early', floor((state.done[i] - state.base[i]) * p + 1e-9D) > slot - state.start,
    'deadline', ceil((state.done[i] - state.base[i] + 1) * p - 1e-9D),
    'source', i)))).source),
  s -> transform(
    array(transform(state.done, (d, i) -> d + if(i = s, 1L, 0L))),
    now -> named_struct(
      'done', now,
      'base', if(now[s] < caps[s], state.base, now),
      'start', if(now[s] < caps[s], state.start, slot + 1L),
      'span', if(now[s] < caps[s], state.span, {spans}){slots}))[0])[0]
"""
_FIRST_PASS = """
aggregate(
  sequence(0L, cast((total - 1) div {segment} as bigint)),
  named_struct('at', {zero}, 'marks', array_remove(array({zero}), {zero})),
  (held, segment) -> named_struct(
    'at', aggregate(
      sequence(segment * {segment}L, least(total, (segment + 1) * {segment}L) - 1),
      held.at, (state, slot) -> {step}),
    'marks', concat(held.marks, array(held.at))),
  held -> held.marks)
"""
_SECOND_PASS = """
aggregate(
  sequence(segment * {segment}L, least(total, (segment + 1) * {segment}L) - 1),
  named_struct('done', mark.done, 'base', mark.base, 'start', mark.start, 'span', mark.span,
               'slots', cast(array() as array<struct<source:int,block:bigint>>)),
  (state, slot) -> {step},
  state -> state.slots)
"""

# With a period. State of the fold over its slots: blocks done by source, and (source, block) by slot.
# A source is eligible if it has blocks left and its next one is released; eligible sources are
# compared by deadline, then by place.
_EDF = """
aggregate(
  sequence(0, cast(length - 1 as int)),
  named_struct('done', transform(blocks, c -> 0L),
               'slots', cast(array() as array<struct<source:int,block:bigint>>)),
  (state, slot) -> transform(
    array(array_min(filter(
      transform(blocks, (c, s) -> struct(
        if(state.done[s] < c and floor(state.done[s] * length / c) <= slot,
           ceil((state.done[s] + 1) * length / c), null) as deadline,
        s as source)),
      x -> x.deadline is not null)).source),
    s -> named_struct(
      'done', transform(state.done, (d, i) -> d + if(i = s, 1L, 0L)),
      'slots', concat(state.slots, array(named_struct('source', s, 'block', state.done[s])))))[0],
  state -> state.slots)
"""


def quotas(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source",
           block_rows: int = BLOCK_ROWS, period: int = PERIOD_BLOCKS) -> DataFrame:
    """(source, rows, blocks, quota, raw, weight): blocks of a source, its weight as given and as a
    part of all, and how many blocks a period takes.

    Quotas are only used with a period: they are the weights times `period`, rounded by largest remainder, one at least. Sources that
    `weights` does not name get weight 0; their blocks come when all other sources have ended, or
    with a period one block a period: no row is left out.
    """
    sizes = docs.groupBy(_source(docs, source).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        raw = F.pow(F.col("rows").cast("double"), F.lit(TEMPERATURE))
    else:
        names = F.create_map(*[F.lit(x) for item in weights.items() for x in item]) if weights else None
        raw = F.lit(1.0) if names is None else F.coalesce(
            F.try_element_at(names, F.col("source")).cast("double"), F.lit(0.0))
    everywhere = Window.partitionBy()  # one row per source
    share = (sizes.withColumn("raw", F.greatest(raw, F.lit(0.0)))
             .withColumn("exact", F.lit(period) * F.col("raw")
                         / F.greatest(F.sum("raw").over(everywhere), F.lit(1e-300)))
             .withColumn("whole", F.floor("exact")))
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("whole")), "source"))
    extra = (rank <= F.lit(period) - F.sum("whole").over(everywhere)).cast("long")
    named = share.withColumn("quota", F.greatest(F.lit(1).cast("long"), F.col("whole") + extra))
    all_raw = F.sum("raw").over(everywhere)
    return named.select("source", "rows", F.ceil(F.col("rows") / block_rows).alias("blocks"), "quota",
                        "raw", F.when(all_raw > 0, F.col("raw") / all_raw)
                        .otherwise(1 / F.count("*").over(everywhere)).alias("weight"))


def schedule(shares: DataFrame) -> DataFrame:
    """(source, block, slot) of every block of `shares` by its unrounded weights.

    The sources (one row each, a vocabulary) are one array here. A first pass goes through all
    slots, keeps only counts, and marks them every SEGMENT slots; segments are then scheduled
    apart from each other from their marks.
    """
    zero = ("named_struct('done', transform(caps, c -> 0L), 'base', transform(caps, c -> 0L), "
            "'start', 0L, 'span', span)")
    spans = _SPANS.format(done="now")
    one = (shares.where("blocks > 0").groupBy()
           .agg(F.array_sort(F.collect_list(F.struct("source", "raw", "blocks"))).alias("s")).where("size(s) > 0")
           .select(F.expr("s.source").alias("names"), F.expr("s.raw").alias("raw"),
                   F.expr("s.blocks").alias("caps"))
           .withColumn("none", F.expr("transform(caps, c -> 0L)"))
           .withColumn("span", F.expr(_SPANS.format(done="none")))
           .withColumn("total", F.expr("aggregate(caps, 0L, (a, c) -> a + c)")))
    first = _FIRST_PASS.format(segment=SEGMENT, zero=zero, step=_STEP.format(spans=spans, slots=""))
    marks = one.select("names", "raw", "caps", "total", F.posexplode(F.expr(first)).alias("segment", "mark"))
    taken = ", 'slots', concat(state.slots, array(named_struct('source', s, 'block', state.done[s])))"
    second = _SECOND_PASS.format(segment=SEGMENT, step=_STEP.format(spans=spans, slots=taken))
    placed = (marks.withColumn("segment", F.col("segment").cast("long")).repartition("segment")
              .select("names", "segment", F.posexplode(F.expr(second)).alias("at", "x")))
    return placed.select(F.col("names")[F.col("x.source")].alias("source"), F.col("x.block").alias("block"),
                         (F.col("segment") * SEGMENT + F.col("at")).alias("slot"))


def schedule_periods(shares: DataFrame) -> DataFrame:
    """(source, block, slot) of every block of `shares` by the quotas of a period.

    While all sources last, a period takes each source's quota. A source with fewer blocks left
    gives those to one last period; that and later periods are shorter, and their targets are
    the blocks that they take. The sources (one row each, a vocabulary) are one array here.
    """
    one = shares.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("source", "quota", "blocks"))).alias("s"),
        F.max(F.ceil(F.col("blocks") / F.col("quota"))).alias("periods")).where("periods > 0")
    periods = one.select("s", F.explode(F.expr("sequence(0L, periods - 1)")).alias("period")).select(
        "s", "period",
        F.expr("transform(s, x -> least(x.quota, greatest(0L, x.blocks - period * x.quota)))")
        .alias("blocks"),
        F.expr("aggregate(s, 0L, (a, x) -> a + least(x.blocks, period * x.quota))").alias("before"))
    patterns = (periods.select("blocks").distinct()
                .withColumn("length", F.expr("aggregate(blocks, 0L, (a, c) -> a + c)"))
                .withColumn("slots", F.expr(_EDF)).drop("length"))
    placed = periods.join(patterns, "blocks").select(
        "s", "period", "before", F.posexplode("slots").alias("at", "x"))
    own = F.col("s")[F.col("x.source")]
    return placed.select(own["source"].alias("source"),
                         (F.col("period") * own["quota"] + F.col("x.block")).alias("block"),
                         (F.col("before") + F.col("at")).alias("slot"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source",
        doc_id: str = "doc_id", block_rows: int = BLOCK_ROWS, period: int | None = None,
        seed: int = 0) -> DataFrame:
    """Adds mix_block, mix_slot and mix_position to the rows; ordering by mix_position mixes them.

    Every row stays, once. A source's rows are dealt to blocks in an order that follows a hash of
    the id; a source's last block may be shorter. A null source counts as the source named "", rows
    without an id and repeated rows are rows like others. An empty table gives none. Columns of the
    result's names are replaced.
    """
    added = ["mix_block", "mix_slot", "mix_position"]
    rows = docs.drop(*added, "_source", "_hash", "_part", "_place", "_before")
    rows = (rows.withColumn("_source", _source(docs, source))
            .withColumn("_hash", F.xxhash64(docs[doc_id], F.lit(seed)))
            .withColumn("_part", F.shiftrightunsigned(
                F.col("_hash"), 64 - (PARTS.bit_length() - 1)).cast("int")))
    sizes = rows.groupBy("_source", "_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_source").orderBy("_part")
                             .rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("_source", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = Window.partitionBy("_source", "_part").orderBy("_hash", F.col(doc_id))
    placed = (rows.withColumn("_place", F.row_number().over(own).cast("long"))
              .join(begins, ["_source", "_part"])
              .withColumn("_place", F.col("_before") + F.col("_place") - 1)
              .withColumn("mix_block", F.floor(F.col("_place") / block_rows)))
    shares = quotas(docs, weights, source, block_rows, period or PERIOD_BLOCKS)
    slots = (schedule_periods if period else schedule)(shares).select(F.col("source").alias("_source"), F.col("block").alias("mix_block"),
                                    F.col("slot").alias("mix_slot"))
    return (placed.join(slots, ["_source", "mix_block"])
            .withColumn("mix_position",
                        F.col("mix_slot") * block_rows + F.col("_place") % block_rows)
            .select(*[c for c in rows.columns if not c.startswith("_")], *added))


def _source(docs: DataFrame, source: str) -> Column:
    return F.coalesce(docs[source].cast("string"), F.lit(""))


def report(docs: DataFrame) -> DataFrame:
    mixed = mix(docs.select("doc_id", "source"))
    shares = quotas(docs).select(F.col("source").alias("name"), "weight")
    return mixed.join(shares, F.coalesce("source", F.lit("")).eqNullSafe(F.col("name"))).select(
        "doc_id", "source", F.round("weight", 9).alias("target_weight"), "mix_block", "mix_slot",
        "mix_position")

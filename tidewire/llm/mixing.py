"""Mixing sources to target weights: Pfair windows for blocks of each source, interleaved earliest deadline first.

A source with u of the q units owes block j (from 0) between its release floor(j q / u) and its deadline
ceil((j + 1) q / u); in each slot the released block with the earliest deadline goes. The units fill q slots, so no
deadline is missed, and after any number of slots a source has had u / q of them to within less than one block.

The slots are dealt in chunks, each a row of its own, so that the schedule of any length is made in parallel and in SQL
functions alone. What a chunk needs is how many blocks each source has had before it. That is known without the slots
before: source i has had all blocks due by then, floor(u t / q), and of the sources that have one more, those of earliest
deadline that can be placed. A set can be placed if for each slot s no more blocks than t - s are released from s on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16
FINE = 10**12  # units in all, fewer where slots times units would leave 64 bits
MOST = 4 * 10**18
CHUNK, LONG_CHUNK = 512, 65536  # slots of a row: the longer, the rarer is a source's turn
SHORT = 256  # slots whose blocks are gathered in one array
GROUP_ROWS = 256

#: From units and q, before slot t: done, the blocks each source has had.
_STATE = """
    transform(units, u -> named_struct('done', (u * t) div q, 'part', (u * t) % q,
        'release', ((u * t) div q * q) div u, 'deadline', (((u * t) div q + 1) * q + u - 1) div u))
"""
#: The sources that can have one block more, earliest deadline first, and the slots in which they could lack room.
_OPEN = "array_sort(filter(transform(state, (s, i) -> named_struct('deadline', s.deadline, 'i', i, 'release', s.release, 'part', s.part)), s -> s.part > 0))"
_ROOM = """
    if(size(open) = 0, cast(array() as array<bigint>), transform(sequence(array_min(transform(open, o -> o.release)), t - 1), s ->
        t - s - aggregate(zip_with(units, state, (u, x) -> greatest(0L, x.done - (u * s + q - 1) div q)), 0L, (a, x) -> a + x)))
"""
_CHOSEN = """
    aggregate(open, named_struct('room', room, 'left', t - aggregate(state, 0L, (a, s) -> a + s.done), 'chosen', cast(array() as array<int>)),
        (a, o) -> if(a.left > 0 and array_min(slice(a.room, 1, cast(o.release - (t - size(a.room)) + 1 as int))) > 0,
            named_struct('room', transform(a.room, (r, k) -> if(k <= o.release - (t - size(a.room)), r - 1, r)), 'left', a.left - 1, 'chosen', concat(a.chosen, array(o.i))),
            a),
        a -> a.chosen)
"""
_DONE = "transform(state, (s, i) -> s.done + if(array_contains(chosen, i), 1L, 0L))"
_STEP = """
    element_at(transform(
        array(array_min(filter(transform(units, (u, s) ->
            if((state.done[s] * q) div u <= slot, named_struct('deadline', ((state.done[s] + 1) * q + u - 1) div u, 's', s, 'j', state.done[s]), null)
        ), e -> e is not null))),
        p -> named_struct('done', transform(state.done, (d, s) -> if(s = p.s, d + 1, d)), 'picked', concat(state.picked, array(named_struct('s', p.s, 'j', p.j))))
    ), 1)
"""
#: The block of each slot of a chunk, as (source, its number). An array that grows is copied at each step, so slots go by SHORT.
_EDF = f"""
    aggregate(
        sequence(t, t + chunk - 1, {SHORT}L),
        named_struct('done', done, 'picked', cast(array() as array<array<struct<s:int,j:bigint>>>)),
        (before, lo) -> element_at(transform(
            array(aggregate(
                sequence(lo, least(lo + {SHORT - 1}, t + chunk - 1)),
                named_struct('done', before.done, 'picked', cast(array() as array<struct<s:int,j:bigint>>)),
                (state, slot) -> {_STEP}
            )),
            x -> named_struct('done', x.done, 'picked', concat(before.picked, array(x.picked)))
        ), 1),
        state -> flatten(state.picked)
    )
"""


def _source_key(column: Column) -> Column:
    """A text for each source, null's too."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def source_units(counts: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row from (key, n): keys, units, blocks of the sources with a weight, in order of their keys; the sum q of the
    units and the number of slots until all have run out; and the ``rest``, sources whose weight is 0 or not given."""
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        given = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (f"={k}", float(w))]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.element_at(given, F.col("key")), F.lit(0.0))
    source = F.struct("key", weight.alias("w"), F.ceil(F.col("n") / block_rows).cast("long").alias("blocks"))
    row = counts.agg(F.sort_array(F.collect_list(source)).alias("all"))
    row = row.select(F.expr("filter(all, s -> s.w > 0)").alias("on"), F.expr("filter(all, s -> not s.w > 0)").alias("rest"))
    row = row.withColumn("total", F.expr("aggregate(on, 0D, (a, s) -> a + s.w)"))
    row = row.withColumn("fine", F.expr(f"least({FINE}D, floor({MOST}D / greatest(1D, array_max(transform(on, s -> s.blocks * total / s.w)))))"))
    row = row.withColumn("units", F.expr("transform(on, s -> greatest(1L, cast(floor(s.w * fine / total + 0.5D) as bigint)))"))
    row = row.withColumn("q", F.expr("aggregate(units, 0L, (a, u) -> a + u)"))
    slots = F.expr("coalesce(array_max(zip_with(units, on, (u, s) -> (s.blocks * q + u - 1) div u)), 0L)")
    return row.select(F.expr("on.key").alias("keys"), F.expr("on.blocks").alias("blocks"), "units", "q", slots.alias("slots"), "rest")


def schedule(sources: DataFrame) -> DataFrame:
    """key, block and slot of every block of every source, from the row of ``source_units``."""
    spark = sources.sparkSession
    slots, rare = sources.select("slots", F.expr("coalesce(q div array_min(units), 0L)")).first()
    chunk = max(CHUNK, min(LONG_CHUNK, rare))
    chunks = spark.range(-(-slots // chunk), numPartitions=max(1, min(-(-slots // chunk), 2 * spark.sparkContext.defaultParallelism)))
    at = chunks.select((F.col("id") * chunk).alias("t")).join(F.broadcast(sources)).withColumn("chunk", F.least(F.lit(chunk), F.col("slots") - F.col("t")))
    for name, made in (("state", _STATE), ("open", _OPEN), ("room", _ROOM), ("chosen", _CHOSEN), ("done", _DONE), ("picked", _EDF)):
        at = at.withColumn(name, F.expr(made))
    dealt = at.select("keys", "blocks", "t", F.posexplode("picked").alias("k", "p"))
    dealt = dealt.select(F.expr("keys[p.s]").alias("key"), F.col("p.j").alias("block"), (F.col("t") + F.col("k")).alias("slot"), F.expr("blocks[p.s]").alias("blocks"))
    # sources without a weight come after all others, one after the other
    late = sources.select("slots", F.posexplode("rest").alias("k", "s"), "rest")
    first = F.expr("slots + aggregate(slice(rest, 1, k), 0L, (a, x) -> a + x.blocks)")
    late = late.select(F.col("s.key").alias("key"), first.alias("first"), F.explode(F.expr("sequence(0L, s.blocks - 1)")).alias("block"))
    return dealt.where("block < blocks").select("key", "block", "slot").union(late.select("key", "block", (F.col("first") + F.col("block")).alias("slot")))


def mix(df: DataFrame, weights: dict[str, float] | None = None, source: str = "source", id: str = "doc_id", block_rows: int = BLOCK_ROWS, power: float = 0.5) -> DataFrame:
    """Adds mix_seq (the row's number in its source), mix_block and mix_slot to every row; order by mix_slot, mix_seq.

    Without ``weights`` a source weighs as much as its number of rows to ``power``. Rows of a source are numbered by the
    md5 of their id, then by the id, then by all columns, so that repeated rows differ at most in which comes first.
    All rows stay: where a source has run out its slots stay empty, and the others keep their shares of the slots. A
    source of weight 0, or that ``weights`` doesn't name, comes after all others. A null source is a source of its own; a
    null id counts as an empty text. An empty table stays empty; columns named as an output are replaced, in any case.

    Numbering needs no source in one task: rows are numbered within groups of about GROUP_ROWS by md5, and a group's
    first number comes from the groups' counts. One row holds the sources' units; the schedule's work grows with the
    slots there are, at most a source's blocks over its share.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("mix_seq", "mix_block", "mix_slot")])
    rows, digits = df.count(), 1
    while digits < 8 and rows > GROUP_ROWS * 16**digits:
        digits += 1
    md5 = F.md5(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary"))
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    keyed = df.select(F.struct("*").alias("row"), _source_key(F.col(source)).alias("key"), md5.alias("md5"), F.substring(md5, 1, digits).alias("part"), F.xxhash64(*plain).alias("all"))
    parts = keyed.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).checkpoint()
    sources = source_units(parts.groupBy("key").agg(F.sum("n").alias("n")), weights, power, block_rows).checkpoint()
    held = parts.withColumn("block", F.explode(F.expr(f"sequence(before div {block_rows}, (before + n - 1) div {block_rows})")))
    held = held.join(schedule(sources), ["key", "block"]).groupBy("key", "part").agg(F.first("before").alias("before"), F.map_from_entries(F.collect_list(F.struct("block", "slot"))).alias("slots"))
    order = Window.partitionBy("key", "part").orderBy("md5", F.col(f"row.{id}"), "all")
    numbered = keyed.withColumn("k", F.row_number().over(order) - 1).join(held, ["key", "part"])
    seq = F.col("before") + F.col("k")
    numbered = numbered.withColumns({"seq": seq, "block": F.floor(seq / block_rows).cast("long")})
    return numbered.select("row.*", F.col("seq").alias("mix_seq"), F.col("block").alias("mix_block"), F.element_at("slots", F.col("block")).alias("mix_slot"))

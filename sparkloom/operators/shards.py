"""Token shards and training windows as tables. Token order is the order of doc_id.

The stream is never put together: pieces of documents carry their places in it, and shards, windows and batches follow from these."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_before


def placed(encoded: DataFrame) -> DataFrame:
    """ids with the place `first` of their first token in the stream. Encoded rows are stored before they are counted and placed."""
    return running_before(encoded.select("doc_id", "ids"), F.size("ids").cast("long"), "first", then=["ids"])


def pieces(encoded: DataFrame, shard_size: int, skip: int = 0, budget: int | None = None) -> DataFrame:
    """(shard_index, low, piece): each document sends a piece to each shard it reaches into; low is the piece's place in the shard. `skip`:
    the stream begins after so many tokens; `budget`: it ends at this token."""
    at = placed(encoded).withColumn("end", F.col("first") + F.size("ids"))
    last = F.least(F.col("end"), F.lit(budget)) if budget is not None else F.col("end")
    at = at.withColumn("from", F.greatest(F.col("first"), F.lit(skip)) - skip).withColumn("to", last - skip).filter("to > from")
    split = at.select("first", "from", "to", "ids", F.explode(F.expr(f"if(to > from, sequence(from div {shard_size}, (to - 1) div {shard_size}), array())")).alias("shard_index"))
    low, high = F.expr(f"greatest(`from`, shard_index * {shard_size})"), F.expr(f"least(`to`, (shard_index + 1) * {shard_size})")
    cut = F.expr(f"slice(ids, cast(greatest(low - first + {skip}, 0) as int) + 1, cast(greatest(high - low, 0) as int))")
    return split.withColumn("low", low).withColumn("high", high).select("shard_index", F.expr(f"low - shard_index * {shard_size}").alias("low"), cut.alias("piece"))


def assembled(parts: DataFrame, *keys: str) -> DataFrame:
    """(shard_index, tokens) from pieces; a shard is one row."""
    merged = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("low", "piece"))), lambda x: x["piece"]))
    return parts.groupBy("shard_index", *keys).agg(merged.alias("tokens"))


def layout(encoded: DataFrame, shard_size: int) -> DataFrame:
    """(shard_index, tokens): the token at place p of the whole stream is in shard p div shard_size. A row a shard: for shards that fit into a
    row; files are written from pieces()."""
    return assembled(pieces(encoded, shard_size))


def sizes(parts: DataFrame) -> DataFrame:
    """(shard_index, tokens): token counts of shards, from pieces."""
    return parts.groupBy("shard_index").agg(F.sum(F.size("piece")).cast("long").alias("tokens"))


def named(counts: DataFrame) -> DataFrame:
    """(shard_index, filename, tokens)."""
    return counts.select("shard_index", F.format_string("shard_%05d.npy", "shard_index").alias("filename"), "tokens")


def manifest(shards: DataFrame) -> DataFrame:
    return named(shards.select("shard_index", F.size("tokens").cast("long").alias("tokens")))


def window_count(tokens, length: int, stride: int | None = None):
    """Windows of a shard of so many tokens."""
    return F.when(tokens >= length + 1, F.floor((tokens - (length + 1)) / (stride or length)) + 1).otherwise(0).cast("long")


def windows(shards: DataFrame, length: int, stride: int | None = None) -> DataFrame:
    """(shard_index, win_index, input, target) of whole shards: windows that stay in their shard; target is input one token on."""
    stride = stride or length
    k = F.expr(f"cast(floor((size(tokens) - {length + 1}) / {stride}) as int)")
    fits = shards.filter(F.size("tokens") >= length + 1)
    wins = fits.select("shard_index", "tokens", F.explode(F.sequence(F.lit(0), k)).alias("win_index"))
    return wins.select("shard_index", "win_index", F.expr(f"slice(tokens, win_index * {stride} + 1, {length})").alias("input"), F.expr(f"slice(tokens, win_index * {stride} + 2, {length})").alias("target"))


def windows_of_pieces(parts: DataFrame, shard_size: int, length: int, stride: int | None = None) -> DataFrame:
    """windows() from pieces, without whole shards: a window that lies in one piece is cut there and then, the others are put together from
    the parts that pieces hold of them. What the end of the stream leaves unfinished is dropped."""
    stride = stride or length
    last = (shard_size - (length + 1)) // stride
    if last < 0:
        return parts.select("shard_index", F.lit(0).alias("win_index"), F.col("piece").alias("input"), F.col("piece").alias("target")).limit(0)
    first = F.expr(f"greatest(0, ceil((low - {length}) / {stride}))").cast("int")
    upto = F.expr(f"least({last}, floor((low + size(piece) - 1) / {stride}))").cast("int")
    ranged = parts.withColumn("a", first).withColumn("b", upto).filter("a <= b")
    begin = f"(x * {stride} - low)"
    # the condition stands in the expression, too: what is inferred from the generator may be evaluated before the filter
    each = f"transform(if(a <= b, sequence(a, b), array()), x -> struct(x as win_index, greatest({begin}, 0) as at, slice(piece, cast(greatest({begin}, 0) as int) + 1, cast(greatest(0, least({begin} + {length + 1}, size(piece)) - greatest({begin}, 0)) as int)) as part))"
    cut = ranged.select("shard_index", "low", F.explode(F.expr(each)).alias("x")).select("shard_index", (F.col("low") + F.col("x.at")).alias("low"), "x.win_index", F.col("x.part").alias("piece"))
    whole = cut.filter(F.size("piece") == length + 1).select("shard_index", "win_index", F.col("piece").alias("tokens"))
    joined = assembled(cut.filter(F.size("piece") <= length), "win_index").filter(F.size("tokens") == length + 1)
    both = whole.unionByName(joined)
    return both.select("shard_index", "win_index", F.slice("tokens", 1, length).alias("input"), F.slice("tokens", 2, length).alias("target"))


def next_pairs(parts: DataFrame) -> DataFrame:
    """(token, next): each token of a shard with the one after it, from pieces; between pieces only their ends are ordered."""
    pairs = F.transform(F.expr("slice(piece, 1, greatest(size(piece) - 1, 0))"), lambda x, i: F.struct(x.alias("token"), F.get("piece", i + 1).alias("next")))
    inside = parts.select(F.explode(pairs).alias("p")).select("p.*")
    ends = parts.filter("size(piece) > 0").select("shard_index", "low", F.element_at("piece", -1).alias("token"), F.element_at("piece", 1).alias("first"))
    between = ends.select("token", F.lead("first").over(Window.partitionBy("shard_index").orderBy("low")).alias("next")).filter("next is not null")
    return inside.unionByName(between)


def numbered(wins: DataFrame) -> DataFrame:
    """Adds rn, from 0 over all windows in order, from the shards' window counts: a shard is one group of the window."""
    counts = wins.groupBy("shard_index").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("shard_index", (F.sum("c").over(Window.orderBy("shard_index")) - F.col("c")).alias("before"))  # one row a shard
    return wins.join(before, "shard_index").withColumn("rn", F.col("before") + F.col("win_index")).drop("before")


def batches(wins: DataFrame, batch: int, skip_tokens: int = 0, length: int | None = None) -> DataFrame:
    """(batch_id, slot) of full batches; skip_tokens // length windows are left out first."""
    rows = numbered(wins)
    skip = skip_tokens // length if length else 0
    rows = rows.filter(F.col("rn") >= skip).withColumn("rn", F.col("rn") - skip)
    rows = rows.withColumn("batch_id", F.expr(f"rn div {batch}")).withColumn("slot", F.col("rn") % batch)
    full = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == batch).select("batch_id")
    return rows.join(full, "batch_id")


def shard_order(shards: DataFrame, seed: int, epochs: int = 1) -> DataFrame:
    """(epoch, place, shard_index): the shards of each epoch in an order of its own, by a seeded digest. One row a shard and epoch."""
    each = shards.select("shard_index").distinct().select("shard_index", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    key = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("epoch").cast("string"), F.col("shard_index").cast("string")))
    return each.select("epoch", (F.row_number().over(Window.partitionBy("epoch").orderBy(key, "shard_index")) - 1).alias("place"), "shard_index")


def epochs(wins: DataFrame, n_windows: int, skip: int = 0) -> DataFrame:
    """(step, epoch, shard_index, win_index ...): the first n_windows of the endless stream that begins anew when the windows are used up.
    `skip` windows are left out in the first epoch only."""
    rows = numbered(wins)
    total = rows.agg(F.count(F.lit(1)).alias("k"))
    at = rows.crossJoin(F.broadcast(total))  # one row
    times = F.expr(f"cast(ceil(({n_windows} + {skip}) / k) as int)")
    every = at.withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1))).withColumn("step", F.expr(f"epoch * k + rn - {skip}"))
    return every.filter(f"step >= 0 and step < {n_windows}").drop("k", "rn")


def split(shards: DataFrame, val_shard: int, train: bool) -> DataFrame:
    """Training shards or the validation shard; a validation shard that is not there is an error when the plan runs."""
    here = shards.agg(F.max((F.col("shard_index") == val_shard).cast("int")).alias("found"))
    checked = shards.crossJoin(F.broadcast(here)).filter(F.when(F.coalesce("found", F.lit(0)) == 1, True).otherwise(F.raise_error(F.lit(f"no shard {val_shard}")).cast("boolean"))).drop("found")  # here is one row
    return checked.filter(F.col("shard_index") != val_shard if train else F.col("shard_index") == val_shard)


def ordered_files(paths: DataFrame) -> DataFrame:
    """Files (filename) in the order of their shard numbers, which is that of their names up to 100,000 shards."""
    number = F.regexp_extract("filename", "shard_([0-9]+)[.]npy$", 1)
    return paths.filter(number != "").withColumn("shard_index", number.cast("long")).orderBy("shard_index")

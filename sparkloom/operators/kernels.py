"""Numeric kernels over array columns, and training arithmetic, as built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def scaled(x: Column, by: float) -> Column:
    return F.transform(x, lambda v: v * by)


def rms_norm(x: Column, scale: float = 1.0, eps: float = 1e-6) -> Column:
    x = doubles(x)
    root = F.sqrt(total(F.transform(x, lambda v: v * v)) / F.size(x) + eps)
    return F.transform(x, lambda v: v / root * scale)


def rope(x: Column, position: Column, theta: float = 10000.0, invert: bool = False) -> Column:
    """Rotates the pairs (2i, 2i + 1) by position / theta ** (2i / D)."""
    x = doubles(x)
    sign = -1.0 if invert else 1.0

    def rotated(v: Column, k: Column) -> Column:
        even = k % 2 == 0
        angle = position.cast("double") / F.pow(F.lit(theta), (k - k % 2).cast("double") / F.size(x)) * sign
        other = F.get(x, F.when(even, k + 1).otherwise(k - 1))
        return v * F.cos(angle) + F.when(even, -other).otherwise(other) * F.sin(angle)

    return F.transform(x, rotated)


def silu(x: Column) -> Column:
    return F.transform(doubles(x), lambda v: v / (1 + F.exp(-v)))


def log_softmax(x: Column) -> Column:
    x = doubles(x)
    top = F.array_max(x)
    norm = F.log(total(F.transform(x, lambda v: F.exp(v - top)))) + top
    return F.transform(x, lambda v: v - norm)


def d_ff(d_model: Column) -> Column:
    """8/3 of the width in whole multiples of 256, halves to even."""
    return (F.bround(d_model * 8 / 3 / 256, 0) * 256).cast("int")


def lr_schedule(spark: SparkSession, steps: int, warmup: int, peak: float, least: float) -> DataFrame:
    w = min(warmup, max(1, steps // 2))
    step = F.col("id").cast("double")
    cosine = F.lit(least) + (peak - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * (step - w) / (steps - w)))
    return spark.range(steps).select(F.col("id").alias("step"), F.when(step < w, step * peak / w).otherwise(cosine).alias("lr"))


#: The three model presets.
PRESETS = (
    ("25m", 25_000_000, 4, 512, 8, 4, 1280, 32768, 1024, 10000.0),
    ("125m", 125_000_000, 12, 768, 12, 4, 3072, 32768, 1024, 10000.0),
    ("350m", 350_000_000, 24, 1024, 16, 8, 2816, 32768, 2048, 10000.0),
)
PRESET_SCHEMA = "name string, target_params bigint, n_layers int, d_model int, n_heads int, n_kv_heads int, d_ff int, vocab_size int, max_seq_len int, theta_base double"


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRESETS), PRESET_SCHEMA)


def param_count() -> Column:
    """Tied embedding, attention with shared key and value heads, gated feed-forward, norms."""
    return F.expr("cast(vocab_size as bigint) * d_model + n_layers * (2L * d_model * d_model + 2L * d_model * (d_model div n_heads) * n_kv_heads + 3L * d_model * d_ff) + (2 * n_layers + 1) * d_model")


def causal_attention(rows: DataFrame, id_col: str, vector: str, context: int, heads: int, kv_heads: int, block: int = 64) -> DataFrame:
    """(id, head, out): each row attends to the rows of its context (ids in runs of `context`) up to itself. Query heads are slices of
    the vector; consecutive ones share a slice as key and value.

    Keys are gathered in blocks of `block` rows. A query and a block give a part: the greatest score, the sum of the weights relative to it,
    and the sum of the weighed values. Parts merge by sums after scaling to the greatest of their greatest scores, so nothing grows with the
    context but the number of a query's parts, which is that of blocks."""
    x, width = doubles(F.col(vector)), F.expr(f"cast(size({vector}) div {heads} as int)")
    base = rows.select(F.col(id_col).alias("id"), F.expr(f"{id_col} div {context}").alias("context"), F.expr(f"{id_col} % {context} div {block}").alias("block"), x.alias("x"), width.alias("width"))
    keys = base.groupBy("context", F.col("block").alias("of")).agg(F.collect_list(F.struct(F.col("id").alias("key"), "x")).alias("keys"))  # `block` rows at most, but for repeated ids
    head = F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head")
    both = base.join(keys, "context").filter("of <= block").select("id", "width", "x", "keys", head)
    own = lambda v, h: F.slice(v, h * F.col("width") + 1, F.col("width"))
    shared = F.expr(f"cast(head div {heads // kv_heads} as int)")
    seen = F.transform(F.filter("keys", lambda k: k["key"] <= F.col("id")), lambda k: own(k["x"], shared))
    scored = both.select("id", "head", "width", own(F.col("x"), F.col("head")).alias("q"), seen.alias("v")).filter("size(v) > 0")
    scored = scored.withColumn("s", F.transform("v", lambda v: total(F.zip_with("q", v, lambda a, b: a * b)) / F.sqrt("width")))
    scored = scored.withColumn("m", F.array_max("s")).withColumn("e", F.transform("s", lambda s: F.exp(s - F.col("m"))))
    part = F.aggregate(F.arrays_zip("v", "e"), F.transform("q", lambda _: F.lit(0.0)), lambda acc, x: F.zip_with(acc, x["v"], lambda a, v: a + v * x["e"]))
    parts = scored.select("id", "head", "m", total(F.col("e")).alias("sum"), part.alias("o"))
    scaled = parts.withColumn("f", F.exp(F.col("m") - F.max("m").over(Window.partitionBy("id", "head"))))
    merged = scaled.select("id", "head", (F.col("sum") * F.col("f")).alias("sum"), F.posexplode(F.transform("o", lambda v: v * F.col("f"))).alias("i", "v"))
    values = merged.groupBy("id", "head", "i").agg((F.sum("v") / F.sum("sum")).alias("v"))
    return values.groupBy("id", "head").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("out"))  # a vector's numbers


def adamw_first_step(param: Column, grad: Column, lr: float, decay: float, eps: float = 1e-8) -> Column:
    """Parameters after the first step, where the bias-corrected moments are the gradient and its square."""
    return F.zip_with(doubles(param), doubles(grad), lambda p, g: p - lr * (g / (F.sqrt(g * g) + eps) + decay * p))


def adamw(param: Column, grads: Column, lr: float, decay: float, b1: float = 0.9, b2: float = 0.95, eps: float = 1e-8) -> Column:
    """Parameters after a step for each gradient in the array `grads`, moments corrected for bias, decay apart from the gradient."""

    def step(acc: Column, g: Column) -> Column:
        t = acc["t"] + 1
        m = F.zip_with(acc["m"], g, lambda a, x: a * b1 + x * (1 - b1))
        v = F.zip_with(acc["v"], g, lambda a, x: a * b2 + x * x * (1 - b2))
        by = F.zip_with(m, v, lambda a, s: a / (1 - F.pow(F.lit(b1), t)) / (F.sqrt(s / (1 - F.pow(F.lit(b2), t))) + eps))
        return F.struct(F.zip_with(acc["p"], by, lambda p, u: p - lr * (u + decay * p)).alias("p"), m.alias("m"), v.alias("v"), t.alias("t"))

    p = doubles(param)
    zeros = F.transform(p, lambda _: F.lit(0.0))
    return F.aggregate(grads, F.struct(p.alias("p"), zeros.alias("m"), zeros.alias("v"), F.lit(0).alias("t")), step, lambda acc: acc["p"])


def matvec(x: Column, rows: list[list[float]]) -> Column:
    """A constant matrix, given by rows, times a vector."""
    return F.array(*[total(F.zip_with(x, F.array(*map(F.lit, r)), lambda a, b: a * b)) for r in rows])


def swiglu(x: Column, gate: list[list[float]], up: list[list[float]], down: list[list[float]]) -> Column:
    """down (silu(gate x) * (up x)); matrices by rows."""
    x = doubles(x)
    return matvec(F.zip_with(silu(matvec(x, gate)), matvec(x, up), lambda a, b: a * b), down)


def cross_entropy(logits: Column, target: Column) -> Column:
    return -F.get(log_softmax(logits), target)


def parameters(presets: DataFrame) -> DataFrame:
    """(name, module, leaf, rows, cols): a row for every tensor of a model, vectors with one column."""
    leaf = lambda name, r, c: F.struct(F.lit(name).alias("leaf"), F.expr(f"cast({r} as bigint)").alias("rows"), F.expr(f"cast({c} as bigint)").alias("cols"))
    kv = "(d_model div n_heads) * n_kv_heads"
    block = F.array(
        leaf("attn/wq", "d_model", "d_model"), leaf("attn/wk", "d_model", kv), leaf("attn/wv", "d_model", kv), leaf("attn/wo", "d_model", "d_model"),
        leaf("mlp/w_gate", "d_model", "d_ff"), leaf("mlp/w_up", "d_model", "d_ff"), leaf("mlp/w_down", "d_ff", "d_model"), leaf("norm_attn/scale", "d_model", "1"), leaf("norm_mlp/scale", "d_model", "1"),
    )
    layers = presets.select("name", F.explode(F.expr("sequence(0, n_layers - 1)")).alias("i"), block.alias("b")).select("name", F.concat(F.lit("block_"), "i").alias("module"), F.explode("b").alias("x"))
    ends = F.array(F.struct(F.lit("tok_emb").alias("module"), leaf("embedding", "vocab_size", "d_model").alias("x")), F.struct(F.lit("norm_final").alias("module"), leaf("scale", "d_model", "1").alias("x")))
    outer = presets.select("name", F.explode(ends).alias("e")).select("name", "e.module", "e.x")
    return layers.unionByName(outer).select("name", "module", "x.*")


def reconcile(model: DataFrame, saved: DataFrame, prefix: str = "params/") -> DataFrame:
    """(param, problem): parameters (param, rows, cols) that the saved ones lack (missing), have in another shape (shape) or have beside the
    model's (unexpected). Saved names may carry the prefix."""
    s = saved.select(F.when(F.col("param").startswith(prefix), F.expr(f"substring(param, {len(prefix) + 1})")).otherwise(F.col("param")).alias("param"), F.col("rows").alias("r"), F.col("cols").alias("c"), F.lit(True).alias("saved"))
    both = model.withColumn("known", F.lit(True)).join(s, "param", "full_outer")
    problem = F.when(F.col("saved").isNull(), "missing").when(F.col("known").isNull(), "unexpected").when((F.col("rows") != F.col("r")) | (F.col("cols") != F.col("c")), "shape")
    return both.select("param", problem.alias("problem")).filter("problem is not null")

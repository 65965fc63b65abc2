"""Named queries over the test tables, each beside its DuckDB equivalent."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import tables
from sparkloom.functions.merges import MERGES
from sparkloom.functions.patterns import FIRST_MERGE, SPECIALS, WS, special_pattern
from sparkloom.functions.permutation import permuted_sql
from sparkloom.operators import bpe, documents, kernels, model, ordered, shards
from sparkloom.sources import configs, corpus_text, npy_shards, safetensors, shard_source, text_pieces, training_log
from sparkloom.sources.files import new_folder, stored
from sparkloom.sources.token_dataset import TokenDataset
from sparkloom.streaming import encode as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CHARS, TOKENS, SHARD, LENGTH, STRIDE, BATCH, VAL = 200_000, 300_000, 20_000, 128, 64, 8, 1


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return documents.read(spark, sf, "documents")


# ---- pieces of SQL

CHAR_SQL = "select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as char_count from documents"
LONG_SQL = f"select * from ({CHAR_SQL}) where char_count >= 100"


def tokens_sql(tail: str, text: str = "coalesce(text, '')") -> str:
    """The list of pre-tokens of a text: a mark before the last white space of a run stands for the lookahead that RE2 lacks."""
    return (
        f"flatten(list_transform(string_split(regexp_replace({text}, '([{WS}])([^{WS}])', chr(1) || '\\1\\2', 'g'), chr(1)), "
        f"lambda x: regexp_extract_all(x, '''s|''t|''re|''ve|''m|''ll|''d|{tail}')))"
    )


_TAIL = rf" ?[\p{{L}}\p{{N}}_]+| ?[^{WS}\p{{L}}\p{{N}}_]+|[{WS}]+"
PT = tokens_sql(_TAIL)
PT_SPLIT = tokens_sql(rf" ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+")
FREQ_SQL = f"select word, count(*)::bigint as freq from (select unnest({PT}) as word from documents) group by word"
HEX_IDS = "list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: ('0x' || h)::int + 5)"
PAIRS_SQL = f"select ids[i] as a, ids[i + 1] as b, sum(freq)::bigint as n from (select ids, freq, unnest(range(1, len(ids))) as i from (select {HEX_IDS} as ids, freq from ({FREQ_SQL}))) group by 1, 2"


def _fold() -> str:
    s = "s"
    for k, (a, b) in enumerate(MERGES):
        s = f"replace({s}, chr({a + 256}) || chr({b + 256}), chr({FIRST_MERGE + k + 256}))"
    return s


_WORD_CHARS = "array_to_string(list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: chr(('0x' || h)::int + 261)), '')"
IDS_SQL = (
    f"select doc_id, case when coalesce(text, '') = '' then [] else list_transform(string_split(replace({_fold()}, chr(57344), ''), ''), lambda c: unicode(c) - 256) end as ids "
    f"from (select doc_id, text, array_to_string(list_transform({PT}, lambda w: {_WORD_CHARS}), chr(57344)) as s from documents)"
)
ENC_SQL = f"select doc_id, list_concat([0], ids) as ids from ({IDS_SQL})"
ENC_AT_SQL = f"select doc_id, ids, (sum(len(ids)) over (order by doc_id) - len(ids))::bigint as first from ({ENC_SQL})"
FLAT_SQL = f"select first + i - 1 as pos, ids[i] as tok from (select first, ids, unnest(range(1, len(ids) + 1)) as i from ({ENC_AT_SQL}))"
SHARDS_SQL = f"select (pos // {SHARD})::bigint as shard_index, list(tok order by pos) as tokens from ({FLAT_SQL}) group by 1"


def wins_sql(stride: int) -> str:
    return (
        f"select shard_index, w::bigint as win_index, tokens[w * {stride} + 1 : w * {stride} + {LENGTH}] as input, tokens[w * {stride} + 2 : w * {stride} + {LENGTH + 1}] as target "
        f"from (select shard_index, tokens, unnest(range(0, ((len(tokens) - {LENGTH + 1}) // {stride} + 1)::bigint)) as w from ({SHARDS_SQL}) where len(tokens) >= {LENGTH + 1})"
    )


NUMBERED_SQL = f"select *, row_number() over (order by shard_index, win_index) - 1 as rn from ({wins_sql(LENGTH)})"


def text_of(col: str) -> str:
    return f"array_to_string({col}, ',')"


_VOCAB = bpe.vocabulary(MERGES)


# ---- documents


@query(f"select doc_id, char_count from ({LONG_SQL})")
def doc_min_length(spark: SparkSession, sf: str) -> DataFrame:
    return documents.min_length(docs(spark, sf)).select("doc_id", "char_count")


@query("select doc_id, md5(text) as digest from documents where text is not null and text <> ''")
def doc_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    return documents.non_empty(docs(spark, sf)).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(f"select doc_id, row_number() over (order by doc_id) - 1 as dense_id from ({LONG_SQL})")
def doc_dense_id(spark: SparkSession, sf: str) -> DataFrame:
    return documents.dense_ids(docs(spark, sf)).select("doc_id", "dense_id")


@query("select count(*)::bigint as docs, count(*) filter (char_count >= 100)::bigint as kept, count(*) filter (char_count < 100)::bigint as skipped, sum(char_count)::bigint as chars, round(avg(char_count), 6) as avg_chars from (" + CHAR_SQL + ")")
def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("char_count")
    return documents.with_chars(docs(spark, sf)).agg(F.count(F.lit(1)).alias("docs"), F.count_if(c >= 100).alias("kept"), F.count_if(c < 100).alias("skipped"), F.sum(c).alias("chars"), F.round(F.avg(c), 6).alias("avg_chars"))


@query(f"select doc_id, char_count, before::bigint as chars_before from (select *, sum(char_count) over (order by doc_id) - char_count as before from ({LONG_SQL})) where before < {CHARS} or before = 0")
def char_budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return documents.char_budget(docs(spark, sf), CHARS).select("doc_id", "char_count", "chars_before")


@query(f"select doc_id, least(len(ids), {TOKENS} - first)::bigint as n_tokens, md5({text_of(f'ids[1 : least(len(ids), {TOKENS} - first)]')}) as digest from ({ENC_AT_SQL}) where first < {TOKENS}")
def token_budget_truncate(spark: SparkSession, sf: str) -> DataFrame:
    # only documents that the budget can reach, by their bytes, are encoded
    needed = documents.least_tokens(docs(spark, sf), TOKENS, max(map(len, _VOCAB.values())))
    cut = documents.token_budget(bpe.encode_documents(needed, MERGES), TOKENS)
    return cut.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join("ids", ",")).alias("digest"))


@query("select budget, count(*) filter (before < budget or before = 0)::bigint as docs, coalesce(sum(char_count) filter (before < budget or before = 0), 0)::bigint as chars from (select *, sum(char_count) over (order by doc_id) - char_count as before from (" + LONG_SQL + ")), (select unnest([100000, 1000000, 5000000, 10000000])::bigint as budget) group by budget")
def budget_by_preset(spark: SparkSession, sf: str) -> DataFrame:
    lengths = documents.min_length(docs(spark, sf)).select("doc_id", "char_count")
    rows = ordered.running_before(lengths, F.col("char_count"), "b").select("char_count", F.col("b"), F.explode(F.array(*[F.lit(x).cast("long") for x in (100_000, 1_000_000, 5_000_000, 10_000_000)])).alias("budget"))
    inside = (F.col("b") < F.col("budget")) | (F.col("b") == 0)
    return rows.groupBy("budget").agg(F.count_if(inside).alias("docs"), F.coalesce(F.sum(F.when(inside, F.col("char_count"))), F.lit(0)).cast("long").alias("chars"))


# ---- pre-tokens


@query(f"select doc_id, len({PT})::bigint as n, md5(array_to_string({PT}, chr(1))) as digest from documents")
def pretokens_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    p = bpe.pretokens(F.col("text"))
    return docs(spark, sf).select("doc_id", p.alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.encode(F.array_join("p", "\x01"), "UTF-8")).alias("digest"))


@query(FREQ_SQL)
def pretoken_freq(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.pretoken_freq(docs(spark, sf))


@query(f"select count(distinct word)::bigint as n from (select unnest({PT}) as word from documents)")
def distinct_pretokens(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.pretoken_freq(docs(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


@query(f"select word, count(*)::bigint as freq from (select unnest({PT_SPLIT}) as word from documents) group by word")
def pretoken_letters_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.pretoken_freq(docs(spark, sf), split_digits=True)


# ---- learning merges


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.pretoken_freq(docs(spark, sf)).select("word", bpe.word_ids(F.col("word")).alias("ids"), "freq")


@query(PAIRS_SQL)
def pair_counts_iter1(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.pair_counts(_words(spark, sf))


@query(f"select * from ({PAIRS_SQL}) order by n desc, a desc, b desc limit 1")
def best_pair_iter1(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.best_pair(bpe.pair_counts(_words(spark, sf)))


_FIRST = f"chr({MERGES[0][0] + 256}) || chr({MERGES[0][1] + 256})"


@query(f"select word, replace(s, {_FIRST}, chr({FIRST_MERGE + 256})) as merged from (select word, array_to_string(list_transform({HEX_IDS}, lambda i: chr(i + 256)), '') as s from ({FREQ_SQL}))")
def apply_first_merge(spark: SparkSession, sf: str) -> DataFrame:
    a, b = MERGES[0]
    s = F.array_join(F.transform(bpe.word_ids(F.col("word")), lambda i: F.element_at(F.array(*[F.lit(chr(x + 256)) for x in range(FIRST_MERGE)]), i + 1)), "")
    return bpe.pretoken_freq(docs(spark, sf)).select("word", F.replace(s, F.lit(chr(a + 256) + chr(b + 256)), F.lit(chr(FIRST_MERGE + 256))).alias("merged"))


@query("select * from (values " + ", ".join(f"({i}, '{t.hex()}')" for i, t in _VOCAB.items()) + ") t(token_id, token_hex)")
def vocab_table(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.vocab_table(spark, MERGES).select("token_id", F.lower(F.hex("token")).alias("token_hex"))


@query("select token_id, token_hex from (" + SQL["vocab_table"] + f") where token_id >= {FIRST_MERGE}")
def merge_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.merge_bytes(spark, MERGES).select("token_id", F.lower(F.hex("token")).alias("token_hex"))


@query(SQL["vocab_table"])
def tokenizer_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.vocab_table(spark, bpe.load(bpe.save(MERGES, new_folder(spark, "tokenizer")))).select("token_id", F.lower(F.hex("token")).alias("token_hex"))


_LEARNED, _INDEXED = 4, 32


def _learned_sql(n: int) -> str:
    """The first merges, each from pair counts over the words as the merges before have left them."""
    steps = [f"s0 as materialized (select freq, array_to_string(list_transform({HEX_IDS}, lambda i: chr(i + 256)), '') as s from ({FREQ_SQL}))"]
    for k in range(n):
        steps.append(f"p{k} as materialized (select s[i] as a, s[i + 1] as b, sum(freq) as n from (select s, freq, unnest(range(1, length(s))) as i from s{k}) group by 1, 2 order by n desc, unicode(s[i]) desc, unicode(s[i + 1]) desc limit 1)".replace("unicode(s[i])", "unicode(a)").replace("unicode(s[i + 1])", "unicode(b)"))
        steps.append(f"s{k + 1} as materialized (select freq, replace(s, (select a || b from p{k}), chr({FIRST_MERGE + k + 256})) as s from s{k})")
    return "with " + ", ".join(steps) + " " + " union all ".join(f"select {k} as rank, unicode(a) - 256 as left_id, unicode(b) - 256 as right_id from p{k}" for k in range(n))


@query(_learned_sql(_LEARNED))
def learned_merges(spark: SparkSession, sf: str) -> DataFrame:
    merges = bpe.train(docs(spark, sf), FIRST_MERGE + _LEARNED)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(merges)], "rank int, left_id int, right_id int")


@query(_learned_sql(_INDEXED))
def learned_merges_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Merges learned on the cluster, whatever the number of words."""
    merges = bpe.train(docs(spark, sf), FIRST_MERGE + _INDEXED, driver_words=0)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(merges)], "rank int, left_id int, right_id int")


# ---- running BPE


@query(f"select word, {text_of('ids')} as ids from (select word, list_transform(string_split({_fold()}, ''), lambda c: unicode(c) - 256) as ids from (select word, {_WORD_CHARS.replace('encode(w)', 'encode(word)')} as s from ({FREQ_SQL})))")
def bpe_encode_words(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.pretoken_freq(docs(spark, sf)).select("word", F.array_join(bpe.encode_text(F.col("word"), MERGES), ",").alias("ids"))


@query(f"select doc_id, len(ids)::bigint as n_tokens, md5({text_of('ids')}) as digest from ({ENC_SQL})")
def bpe_encode_docs(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_documents(docs(spark, sf), MERGES).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join("ids", ",")).alias("digest"))


@query("select doc_id, md5(coalesce(text, '')) as digest from documents")
def bpe_decode_docs(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.decode_documents(bpe.encode_documents(docs(spark, sf), MERGES), MERGES).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("select 0::bigint as violations")
def bpe_roundtrip_violations(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", "text", bpe.encode_text(F.col("text"), MERGES).alias("ids"))
    back = bpe.decode_documents(d.select(F.struct("doc_id", "text").alias("doc_id"), "ids"), MERGES)
    return back.agg(F.count_if(F.col("text") != F.coalesce(F.col("doc_id.text"), F.lit(""))).alias("violations"))


_SPECIAL = special_pattern()


@query(f"select conv_id, turn, len(regexp_extract_all(role || '<|endoftext|>' || text || '<|eos|>', '{_SPECIAL}'))::bigint as n_special, length(regexp_replace(role || '<|endoftext|>' || text || '<|eos|>', '{_SPECIAL}', '', 'g'))::bigint as plain_chars from conversations")
def special_split(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat("role", F.lit("<|endoftext|>"), "text", F.lit("<|eos|>"))
    return documents.read(spark, sf, "conversations").select("conv_id", "turn", F.size(F.regexp_extract_all(t, F.lit(_SPECIAL), F.lit(0))).cast("long").alias("n_special"), F.char_length(F.regexp_replace(t, _SPECIAL, "")).cast("long").alias("plain_chars"))


@query(f"select doc_id, list_min(ids)::int as low, list_max(ids)::int as high, {text_of('list_filter(ids, lambda i: i >= 300)[1:5]')} as first_bad from ({ENC_SQL})")
def id_range_report(spark: SparkSession, sf: str) -> DataFrame:
    e = bpe.encode_documents(docs(spark, sf), MERGES)
    return e.select("doc_id", F.array_min("ids").alias("low"), F.array_max("ids").alias("high"), F.array_join(F.slice(bpe.out_of_range(F.col("ids"), 300), 1, 5), ",").alias("first_bad"))


@query(f"select round(sum(strlen(text))::double / sum(n), 6) as ratio from documents join (select doc_id, len(ids) as n from ({IDS_SQL})) using (doc_id)")
def compression_ratio(spark: SparkSession, sf: str) -> DataFrame:
    tokens = bpe.encode_documents(docs(spark, sf), MERGES, add_eot=False).agg(F.sum(F.size("ids")).alias("n"))
    return docs(spark, sf).agg(F.sum(F.octet_length("text")).alias("b")).crossJoin(tokens).select(F.round(F.col("b") / F.col("n"), 6).alias("ratio"))  # one row each


# ---- shards and windows


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_documents(docs(spark, sf), MERGES)


def _shards(spark: SparkSession, sf: str) -> DataFrame:
    return shards.layout(_encoded(spark, sf), SHARD)


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    """(shard_index, tokens) without shards being put together."""
    return stored(shards.sizes(shards.pieces(_encoded(spark, sf), SHARD)), "shard-sizes")  # a row a shard


def _windows(spark: SparkSession, sf: str, stride: int | None = None) -> DataFrame:
    return shards.windows_of_pieces(shards.pieces(_encoded(spark, sf), SHARD), SHARD, LENGTH, stride)


@query(f"select shard_index, len(tokens)::bigint as n, md5({text_of('tokens')}) as digest from ({SHARDS_SQL})")
def shard_layout(spark: SparkSession, sf: str) -> DataFrame:
    return _shards(spark, sf).select("shard_index", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", ",")).alias("digest"))


@query(f"select shard_index, printf('shard_%05d.npy', shard_index) as filename, len(tokens)::bigint as tokens, (sum(len(tokens)) over ())::bigint as total_tokens, count(*) over () as total_shards from ({SHARDS_SQL})")
def shard_manifest(spark: SparkSession, sf: str) -> DataFrame:
    m = shards.named(_sizes(spark, sf))
    everything = Window.partitionBy(F.lit(0))  # one row a shard
    return m.withColumn("total_tokens", F.sum("tokens").over(everything)).withColumn("total_shards", F.count(F.lit(1)).over(everything))


@query(f"select shard_index, case when shard_index = {VAL} then 'val' else 'train' end as part, len(tokens)::bigint as n from ({SHARDS_SQL})")
def shard_train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    s = _sizes(spark, sf)
    parts = [shards.split(s, VAL, t).select("shard_index", F.lit("train" if t else "val").alias("part"), F.col("tokens").alias("n")) for t in (True, False)]
    return parts[0].unionByName(parts[1])


@query(f"select coalesce(a.shard_index, b.shard_index) as shard_index, a.n as listed, b.n as found, coalesce(a.n = b.n, false) as agrees from (select shard_index, len(tokens)::bigint as n from ({SHARDS_SQL}) where shard_index <> 0) a full join (select shard_index, len(tokens)::bigint as n from ({SHARDS_SQL}) where shard_index <> {VAL}) b on a.shard_index = b.shard_index")
def manifest_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    n = _sizes(spark, sf).withColumnRenamed("tokens", "n")
    a, b = n.filter("shard_index <> 0").withColumnRenamed("n", "listed"), n.filter(f"shard_index <> {VAL}").withColumnRenamed("n", "found")
    return a.join(b, "shard_index", "full_outer").withColumn("agrees", F.coalesce(F.col("listed") == F.col("found"), F.lit(False)))


def _digested(w: DataFrame, *more: str) -> DataFrame:
    return w.select(*more, "shard_index", F.col("win_index").cast("long").alias("win_index"), F.md5(F.array_join("input", ",")).alias("input"), F.md5(F.array_join("target", ",")).alias("target"))


def _digest_sql(inner: str, *more: str) -> str:
    return f"select {''.join(m + ', ' for m in more)}shard_index, win_index, md5({text_of('input')}) as input, md5({text_of('target')}) as target from ({inner})"


@query(_digest_sql(wins_sql(LENGTH)))
def training_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _digested(_windows(spark, sf))


@query(_digest_sql(wins_sql(STRIDE)))
def sql_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows by a table function over pieces, a shard a partition."""
    tables.register(spark)
    shards.pieces(_encoded(spark, sf), SHARD).createOrReplaceTempView("sparkloom_pieces")
    return _digested(spark.sql(f"select * from token_windows(table(sparkloom_pieces) partition by shard_index order by (low), {LENGTH}, {STRIDE})"))


@query(_digest_sql(wins_sql(STRIDE)))
def overlapping_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _digested(_windows(spark, sf, STRIDE))


@query(f"select tok::int as token, nxt::int as next, count(*)::bigint as n from (select tok, lead(tok) over (partition by pos // {SHARD} order by pos) as nxt from ({FLAT_SQL})) where nxt is not null group by 1, 2")
def next_token_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return shards.next_pairs(shards.pieces(_encoded(spark, sf), SHARD)).groupBy("token", "next").agg(F.count(F.lit(1)).alias("n"))


_BATCH_SQL = "select rn // {b} as batch_id, rn % {b} as slot, * from (select * replace (rn - {skip} as rn) from ({inner}) where rn >= {skip}) qualify count(*) over (partition by rn // {b}) = {b}"


@query(_digest_sql(_BATCH_SQL.format(b=BATCH, skip=0, inner=NUMBERED_SQL), "batch_id", "slot"))
def fixed_batches(spark: SparkSession, sf: str) -> DataFrame:
    return _digested(shards.batches(_windows(spark, sf), BATCH), "batch_id", "slot")


@query(_digest_sql(_BATCH_SQL.format(b=BATCH, skip=10, inner=NUMBERED_SQL), "batch_id", "slot"))
def resume_skip(spark: SparkSession, sf: str) -> DataFrame:
    return _digested(shards.batches(_windows(spark, sf), BATCH, 10 * LENGTH + 5, LENGTH), "batch_id", "slot")


@query(f"with v as (select *, count(*) over () as k from ({wins_sql(LENGTH)}) where shard_index = {VAL}) select i // {BATCH} as batch_id, i % {BATCH} as slot, win_index, md5({text_of('input')}) as input from (select unnest(range(0, {BATCH * 25})) as i) join v on i % v.k = v.win_index")
def val_cycle(spark: SparkSession, sf: str) -> DataFrame:
    parts = shards.pieces(_encoded(spark, sf), SHARD)
    v = shards.windows_of_pieces(shards.split(parts, VAL, False), SHARD, LENGTH)
    k = v.agg(F.count(F.lit(1)).alias("k"))
    slots = spark.range(BATCH * 25).crossJoin(F.broadcast(k)).select("id", (F.col("id") % F.col("k")).alias("win_index"))  # k is one row
    return slots.join(v, "win_index").select(F.expr(f"id div {BATCH}").alias("batch_id"), (F.col("id") % BATCH).alias("slot"), F.col("win_index").cast("long").alias("win_index"), F.md5(F.array_join("input", ",")).alias("input"))


@query(f"select greatest(0, (sum(len(tokens)) - 1) // {LENGTH})::bigint as estimate, sum(case when len(tokens) >= {LENGTH + 1} then (len(tokens) - {LENGTH + 1}) // {LENGTH} + 1 else 0 end)::bigint as exact from ({SHARDS_SQL})")
def sequence_estimate_vs_exact(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("tokens")
    exact = shards.window_count(n, LENGTH)
    return _sizes(spark, sf).agg(F.sum(n).alias("t"), F.sum(exact).alias("exact")).select(F.expr(f"greatest(0L, (t - 1) div {LENGTH})").alias("estimate"), "exact")


# ---- configurations and logs

_PRESETS_SQL = "(values " + ", ".join(f"('{p[0]}', {', '.join(map(str, p[1:]))})" for p in kernels.PRESETS) + ") t(name, target_params, n_layers, d_model, n_heads, n_kv_heads, d_ff, vocab_size, max_seq_len, theta_base)"


@query(f"select name, (d_model // n_heads)::int as d_head, (n_heads // n_kv_heads)::int as n_rep, (vocab_size::bigint * d_model + n_layers * (2 * d_model * d_model + 2 * d_model * (d_model // n_heads) * n_kv_heads + 3 * d_model * d_ff) + (2 * n_layers + 1) * d_model)::bigint as params from {_PRESETS_SQL}")
def model_param_count(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.presets(spark).select("name", F.expr("cast(d_model div n_heads as int)").alias("d_head"), F.expr("cast(n_heads div n_kv_heads as int)").alias("n_rep"), kernels.param_count().cast("long").alias("params"))


_HF = (("hidden_size", "d_model"), ("intermediate_size", "d_ff"), ("num_attention_heads", "n_heads"), ("num_hidden_layers", "n_layers"), ("num_key_value_heads", "n_kv_heads"), ("vocab_size", "vocab_size"), ("max_position_embeddings", "max_seq_len"))
_HF_FIXED = (("architectures", "LlamaForCausalLM"), ("model_type", "llama"), ("torch_dtype", "float32"), ("transformers_version", "4.40+"))


@query(f"select {', '.join(f'{b}::int as {a}' for a, b in _HF)}, theta_base::double as rope_theta, 1e-6::double as rms_norm_eps, true as tie_word_embeddings, false as attention_bias, false as mlp_bias, {', '.join(f'{chr(39)}{v}{chr(39)} as {k}' for k, v in _HF_FIXED)} from {_PRESETS_SQL}")
def hf_config_projection(spark: SparkSession, sf: str) -> DataFrame:
    fixed = [F.lit(1e-6).alias("rms_norm_eps"), F.lit(True).alias("tie_word_embeddings"), F.lit(False).alias("attention_bias"), F.lit(False).alias("mlp_bias"), *[F.lit(v).alias(k) for k, v in _HF_FIXED]]
    return kernels.presets(spark).select(*[F.col(b).alias(a) for a, b in _HF], F.col("theta_base").alias("rope_theta"), *fixed)


_LEAVES = [("params/tok_emb/embedding", 2), ("params/block_0/attn/wq", 2), ("params/block_0/attn_norm/scale", 1), ("params/block_0/mlp/w_gate", 2), ("params/final_norm/scale", 1)]


@query("select name, ndim, ndim > 1 and not contains(name, 'tok_emb') as decays, case when ndim >= 2 then 'bf16' else 'fp32' end as dtype from (values " + ", ".join(f"('{n}', {d})" for n, d in _LEAVES) + ") t(name, ndim)")
def weight_decay_mask(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.createDataFrame(_LEAVES, "name string, ndim int")
    return t.select("name", "ndim", F.when(F.col("ndim") <= 1, False).when(F.col("name").contains("tok_emb"), False).otherwise(True).alias("decays"), F.when(F.col("ndim") >= 2, "bf16").otherwise("fp32").alias("dtype"))


@query("select step, round(case when step < 200 then step * 3e-4 / 200 else 3e-5 + (3e-4 - 3e-5) * 0.5 * (1 + cos(pi() * (step - 200) / 800)) end, 12) as lr from (select unnest(range(0, 1000)) as step)")
def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.lr_schedule(spark, 1000, 200, 3e-4, 3e-5).select("step", F.round("lr", 12).alias("lr"))


@query(f"select name, (128 * max_seq_len)::bigint as tokens_per_step, (128 * max_seq_len::bigint * 9766)::bigint as tokens_total, ceil(1000000000.0 / (128 * max_seq_len))::bigint as steps_for_1b from {_PRESETS_SQL}")
def token_step_math(spark: SparkSession, sf: str) -> DataFrame:
    per = F.lit(128).cast("long") * F.col("max_seq_len")
    return kernels.presets(spark).select("name", per.alias("tokens_per_step"), (per * 9766).alias("tokens_total"), F.ceil(F.lit(1e9) / per).alias("steps_for_1b"))


@query(f"select name, d_ff::int as d_ff, (round_even(8.0 * d_model / 3 / 256, 0) * 256)::int as computed from {_PRESETS_SQL}")
def d_ff_check(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.presets(spark).select("name", "d_ff", kernels.d_ff(F.col("d_model")).alias("computed"))


@query("select event_type, round(coalesce(avg(value), 0), 6) as mean_value, count(*)::bigint as n from events where value is not null and not isnan(value) group by event_type")
def eval_series(spark: SparkSession, sf: str) -> DataFrame:
    e = documents.read(spark, sf, "events").filter("value is not null and not isnan(value)")
    return e.groupBy("event_type").agg(F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"))


# ---- kernels

_E = "list_transform(embedding, lambda v: v::double)"


def _vector_sql(expr: str) -> str:
    return f"select vec_id, k::int as k, round(x[k], 5) + 0.0 as value from (select vec_id, x, unnest(range(1, len(x) + 1)) as k from (select vec_id, {expr} as x from (select vec_id, {_E} as e from embeddings)))"


def _vector(df: DataFrame, x) -> DataFrame:
    return df.select("vec_id", F.posexplode(x).alias("i", "v")).select("vec_id", (F.col("i") + 1).alias("k"), (F.round("v", 5) + 0.0).alias("value"))


@query(_vector_sql("list_transform(e, lambda v: v / sqrt(list_sum(list_transform(e, lambda u: u * u)) / len(e) + 1e-6))"))
def rmsnorm_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return _vector(documents.read(spark, sf, "embeddings"), kernels.rms_norm(F.col("embedding")))


@query("select vec_id, k::int as k, round(case when (k - 1) % 2 = 0 then e[k] * cos(a) - e[k + 1] * sin(a) else e[k] * cos(a) + e[k - 1] * sin(a) end, 5) + 0.0 as value from (select *, vec_id::double / pow(10000.0, (k - 1 - (k - 1) % 2)::double / len(e)) as a from (select vec_id, e, unnest(range(1, len(e) + 1)) as k from (select vec_id, " + _E + " as e from embeddings)))")
def rope_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return _vector(documents.read(spark, sf, "embeddings"), kernels.rope(F.col("embedding"), F.col("vec_id")))


@query("select vec_id, round(ln(list_sum(list_transform(e, lambda v: exp(v - list_max(e))))) + list_max(e) - e[1 + (label % len(e))], 6) as loss, list_position(e, list_max(e))::int as argmax from (select vec_id, label, " + _E + " as e from embeddings)")
def log_softmax_ce(spark: SparkSession, sf: str) -> DataFrame:
    e = documents.read(spark, sf, "embeddings")
    p = kernels.log_softmax(F.col("embedding"))
    return e.select("vec_id", F.round(-F.get(p, F.expr("label % size(embedding)")), 6).alias("loss"), F.expr("cast(array_position(embedding, array_max(embedding)) as int)").alias("argmax"))


@query("select round(norm, 6) as norm, round(least(1.0, 1.0 / norm), 9) as factor from (select sqrt(sum(s)) as norm from (select list_sum(list_transform(" + _E + ", lambda v: v * v)) as s from embeddings))")
def global_norm_clip(spark: SparkSession, sf: str) -> DataFrame:
    s = kernels.total(F.transform(kernels.doubles(F.col("embedding")), lambda v: v * v))
    norm = F.sqrt(F.sum("s"))
    return documents.read(spark, sf, "embeddings").select(s.alias("s")).agg(norm.alias("n")).select(F.round("n", 6).alias("norm"), F.round(F.least(F.lit(1.0), 1.0 / F.col("n")), 9).alias("factor"))


@query(_vector_sql("list_transform(e, lambda v: v / (1 + exp(-v)))"))
def silu_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return _vector(documents.read(spark, sf, "embeddings"), kernels.silu(F.col("embedding")))


@query(_vector_sql("list_transform(range(1, len(e) + 1), lambda i: e[i] - 3e-4 * (e[len(e) + 1 - i] / (abs(e[len(e) + 1 - i]) + 1e-8) + 0.1 * e[i]))"))
def adamw_first_step(spark: SparkSession, sf: str) -> DataFrame:
    return _vector(documents.read(spark, sf, "embeddings"), kernels.adamw_first_step(F.col("embedding"), F.reverse("embedding"), 3e-4, 0.1))


@query(f"""with b as (select vec_id, vec_id // 8 as c, {_E} as e from embeddings), h as (select unnest(range(0, 4)) as head),
p as (select q.vec_id, head, k.vec_id as key, q.e[head * 16 + 1 : head * 16 + 16] as q, k.e[(head // 2) * 16 + 1 : (head // 2) * 16 + 16] as v from b q join b k on q.c = k.c and k.vec_id <= q.vec_id cross join h),
s as (select *, list_dot_product(q, v) / 4 as s from p), w as (select *, exp(s - max(s) over (partition by vec_id, head)) as x from s)
select vec_id, head::int as head, k::int as k, round(sum(x * v[k]) / sum(x), 5) + 0.0 as value from w cross join (select unnest(range(1, 17)) as k) group by all""")
def causal_attention(spark: SparkSession, sf: str) -> DataFrame:
    a = kernels.causal_attention(documents.read(spark, sf, "embeddings"), "vec_id", "embedding", 8, 4, 2)
    return a.select(F.col("id").alias("vec_id"), "head", F.posexplode("out").alias("i", "v")).select("vec_id", "head", (F.col("i") + 1).alias("k"), (F.round("v", 5) + 0.0).alias("value"))


# ---- streaming


@query(SQL["bpe_encode_docs"])
def stream_encode_equals_batch(spark: SparkSession, sf: str) -> DataFrame:
    e = streaming.encode_stream(spark, f"{sf}/documents.parquet", MERGES)
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join("ids", ",")).alias("digest"))


@query(SQL["shard_layout"])
def stream_shard_assembly(spark: SparkSession, sf: str) -> DataFrame:
    parts = streaming.shard_stream(spark, f"{sf}/documents.parquet", MERGES, SHARD)
    return _shard_digests(shards.assembled(parts))


@query(SQL["char_budget_prefix"])
def stream_budget_equals_batch(spark: SparkSession, sf: str) -> DataFrame:
    return streaming.budget_stream(spark, f"{sf}/documents.parquet", CHARS).select("doc_id", "char_count", "chars_before")


# ---- special strings, single tokens, large tables


def _shard_digests(s: DataFrame) -> DataFrame:
    return s.select("shard_index", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", ",")).alias("digest"))


_MARKED = "role || '<|endoftext|>' || coalesce(text, '') || '  <|eos|>!!<|pad|>'"
_CUT_SQL = (
    f"flatten(list_transform(range(1, len(string_split_regex(t, '{_SPECIAL}')) + 1), lambda i: list_concat({tokens_sql(_TAIL, f'string_split_regex(t, {chr(39)}{_SPECIAL}{chr(39)})[i]')}, regexp_extract_all(t, '{_SPECIAL}')[i : i])))"
)
_NAMED = "case " + " ".join(f"when w = '{k}' then chr({256 + i})" for k, i in SPECIALS.items()) + f" else {_WORD_CHARS} end"


@query(f"select conv_id, turn, {text_of('ids')} as ids from (select conv_id, turn, list_transform(string_split(replace({_fold()}, chr(57344), ''), ''), lambda c: unicode(c) - 256) as ids from (select conv_id, turn, array_to_string(list_transform({_CUT_SQL}, lambda w: {_NAMED}), chr(57344)) as s from (select conv_id, turn, {_MARKED} as t from conversations)))")
def encode_specials(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents.read(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), F.expr(_MARKED).alias("text"))
    return bpe.encode_documents(rows, MERGES, add_eot=False).select("doc_id.*", F.array_join("ids", ",").alias("ids"))


@query(f"select conv_id, turn, len(ids)::bigint as n from (select conv_id, turn, list_transform(string_split(replace({_fold()}, chr(57344), ''), ''), lambda c: unicode(c) - 256) as ids from (select conv_id, turn, array_to_string(list_transform({tokens_sql(_TAIL, 't')}, lambda w: {_WORD_CHARS}), chr(57344)) as s from (select conv_id, turn, {_MARKED} as t from conversations)))")
def encode_specials_as_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents.read(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), F.expr(_MARKED).alias("text"))
    return bpe.encode_documents(rows, MERGES, add_eot=False, allow_special=False).select("doc_id.*", F.size("ids").cast("long").alias("n"))


@query(f"select conv_id, turn, md5({_MARKED.replace(chr(39) + '<|endoftext|>' + chr(39), chr(39) * 2).replace('<|eos|>', '').replace('<|pad|>', '')}) as bare, md5({_MARKED}) as whole from conversations")
def decode_specials(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents.read(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), F.expr(_MARKED).alias("text"))
    e = stored(bpe.encode_documents(rows, MERGES, add_eot=False), "encoded")
    text = lambda skip, name: bpe.decode_documents(e, MERGES, skip_special=skip).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias(name))
    return text(True, "bare").join(text(False, "whole"), "doc_id").select("doc_id.*", "bare", "whole")


@query(f"select conv_id, turn, array_to_string(list_transform(regexp_extract_all(t, '{_SPECIAL}'), lambda w: case " + " ".join(f"when w = '{k}' then '{i}'" for k, i in SPECIALS.items()) + f" end), ',') as ids from (select conv_id, turn, {_MARKED} as t from conversations)")
def special_membership(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents.read(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), F.expr(_MARKED).alias("text"))
    return bpe.encode_documents(rows, MERGES, add_eot=False).select("doc_id.*", F.array_join(bpe.specials_in(F.col("ids")), ",").alias("ids"))


@query("select * from (values " + ", ".join(f"({i}, '{t.hex()}')" for i, t in _VOCAB.items()) + f", ({len(_VOCAB)}, '3f')) t(token_id, token_hex)")
def single_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(len(_VOCAB) + 1).select(F.col("id").cast("int").alias("token_id"), F.lower(F.hex(bpe.token_text(F.col("id").cast("int"), MERGES))).alias("token_hex"))


@query(f"select doc_id, md5(array_to_string(list_transform(ids, lambda i: lower(printf('%02x%02x', i % 256, i // 256))), '')) as digest from ({ENC_SQL})")
def uint16_encode(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(spark, sf).select("doc_id", F.md5(F.lower(F.hex(bpe.as_uint16(F.col("ids")))).cast("binary")).alias("digest"))


@query(SQL["bpe_encode_docs"])
def encode_by_join(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_by_join(docs(spark, sf), MERGES).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join("ids", ",")).alias("digest"))


@query(SQL["bpe_encode_docs"])
def encode_as_expression(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.concat(F.array(F.lit(0)), bpe.encode_text(F.col("text"), MERGES, SPECIALS))
    return docs(spark, sf).select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join("ids", ",")).alias("digest"))


@query(f"select doc_id, len(ids)::bigint as n_tokens, md5(coalesce(text, '')) as digest, len({PT})::bigint as n_words from documents join ({IDS_SQL}) using (doc_id)".replace("coalesce(text, '')) as digest", "coalesce(documents.text, '')) as digest"))
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    bpe.register(spark, MERGES)
    d = docs(spark, sf).select("doc_id", "text", F.expr("bpe_encode(text)").alias("ids"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.expr("md5(encode(bpe_decode(ids), 'UTF-8'))").alias("digest"), F.expr("cast(size(pretokenize(text)) as bigint)").alias("n_words"))


@query(f"select count(*)::bigint as docs, sum(n)::bigint as tokens, sum(c)::bigint as chars, round(sum(n) / count(*), 6) as tokens_per_doc, round(sum(c) / sum(n), 6) as chars_per_token from (select len(ids) as n, length(coalesce(text, '')) as c from documents join ({ENC_SQL}) using (doc_id))")
def token_counters(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.token_counters(docs(spark, sf), _encoded(spark, sf)).select("docs", "tokens", "chars", F.round("tokens_per_doc", 6).alias("tokens_per_doc"), F.round("chars_per_token", 6).alias("chars_per_token"))


@query("select token_hex, max(token_id)::int as token_id, count(*)::bigint as n from (" + SQL["vocab_table"] + ") where token_id >= 5 group by token_hex")
def vocab_inverse(spark: SparkSession, sf: str) -> DataFrame:
    """Ids by token as a map, and back: tokens that fall together keep the last id."""
    table = bpe.vocab_table(spark, MERGES).filter("token_id >= 5").select(F.lower(F.hex("token")).alias("k"), "token_id").groupBy("k").agg(F.max("token_id").alias("v"), F.count(F.lit(1)).alias("c"))
    inverse = table.agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("v", "c")))).alias("m"))  # a vocabulary has 32,768 entries at most
    return inverse.select(F.explode("m")).select(F.col("key").alias("token_hex"), F.col("value.v").alias("token_id"), F.col("value.c").alias("n"))


# ---- shard files


@query(SQL["shard_layout"])
def npy_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "npy")
    npy_shards.write_documents(_encoded(spark, sf), folder, SHARD)
    return _shard_digests(npy_shards.read(spark, folder))


def _dataset(spark: SparkSession, sf: str, val: int | None = None) -> TokenDataset:
    folder = new_folder(spark, "npy")
    npy_shards.write_documents(_encoded(spark, sf), folder, SHARD)
    return TokenDataset(spark, folder, LENGTH, val_shard=val, batch=BATCH)


@query(f"select * from ({SQL['shard_layout']}) where shard_index = {VAL}")
def npy_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """One shard of a folder: the filter reaches the source, which opens that file alone."""
    return _shard_digests(shards.assembled(npy_shards.read_pieces(spark, _dataset(spark, sf).folder).filter(F.col("shard_index") == VAL)))


@query(SQL["training_windows"])
def windows_from_files(spark: SparkSession, sf: str) -> DataFrame:
    return _digested(_dataset(spark, sf).windows())


_TRAIN_SQL = f"w as materialized (select *, row_number() over (order by shard_index, win_index) - 1 as rn from ({wins_sql(LENGTH)}) where shard_index <> {VAL}), k as materialized (select count(*) as k from w)"


def _epochs_sql(seed: int, skip: int, columns: str, last: str) -> str:
    """Steps after the first `skip`, each epoch in its own order, up to the step `last`."""
    places = "select epoch, place from (select unnest(range(0, 3)) as epoch), (select unnest(range(0, k)) as place from k)"
    order = permuted_sql(places, "(select k from k)", seed)
    return f"with {_TRAIN_SQL}, s as (select epoch * k + place as step, epoch, item from {order} p, k) select {columns} from s join w on item = rn, k where step >= {skip} and step < {last}"


_SHUFFLED, _SKIPPED = 7, 10


@query(_epochs_sql(_SHUFFLED, _SKIPPED, f"(step - {_SKIPPED}) // {BATCH} as batch_id, (step - {_SKIPPED}) % {BATCH} as slot, epoch::int as epoch, shard_index, win_index, md5({text_of('input')}) as input, md5({text_of('target')}) as target", f"{_SKIPPED} + 2 * k // {BATCH} * {BATCH}"))
def shuffled_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of training windows from shard files for two epochs, each in an order of its own, after some windows that an earlier run has had."""
    data = _dataset(spark, sf, VAL)
    return _digested(data.train(2 * len(data) // BATCH, _SKIPPED * LENGTH + 5, _SHUFFLED), "batch_id", "slot", "epoch")


@query(SQL["val_cycle"])
def validation_from_files(spark: SparkSession, sf: str) -> DataFrame:
    return _dataset(spark, sf, VAL).validation(25).select("batch_id", "slot", "win_index", F.md5(F.array_join("input", ",")).alias("input"))


@query(_epochs_sql(_SHUFFLED, 0, f"step, epoch::int as epoch, shard_index, win_index, md5({text_of('input')}) as input, md5({text_of('target')}) as target", "k + 7"))
def window_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The endless stream, stopped within the first epoch and gone on with from its checkpoint into the second."""
    data, folder = _dataset(spark, sf, VAL), new_folder(spark, "window-stream")
    for upto in (len(data) // 2 + 1, len(data) + 7):
        out = data.stream(upto, seed=_SHUFFLED).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
    return _digested(spark.read.schema(shard_source.WINDOWS).parquet(f"{folder}/rows"), "step", "epoch")


CUT = 110_000


@query(f"select shard_index, len(tokens)::bigint as n, md5({text_of('tokens')}) as digest from (select shard_index, list(tok order by pos) as tokens from (select case when pos < {CUT} then pos // {SHARD} else {-(-CUT // SHARD)} + (pos - {CUT}) // {SHARD} end::bigint as shard_index, pos, tok from ({FLAT_SQL}) where pos < {TOKENS}) group by 1)")
def npy_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Shards of a budget, then the same folder gone on with to a larger one."""
    folder, encoded = new_folder(spark, "npy"), stored(_encoded(spark, sf), "encoded")
    npy_shards.write_documents(encoded, folder, SHARD, token_budget=CUT)
    npy_shards.write_documents(encoded, folder, SHARD, token_budget=TOKENS, resume=True)
    return _shard_digests(npy_shards.read(spark, folder))


@query(f"select shard_index, printf('shard_%05d.npy', shard_index) as filename, len(tokens)::bigint as tokens, round((128 + 2 * len(tokens)) / 1e6, 2) as size_mb, true as agrees from ({SHARDS_SQL})")
def npy_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts from the files' headers, a manifest rebuilt from them, read as JSON and compared with the files."""
    folder = new_folder(spark, "npy")
    npy_shards.write_documents(_encoded(spark, sf), folder, SHARD)
    npy_shards.rebuild_manifest(spark, folder, SHARD)
    said = npy_shards.manifest_table(spark, folder).select(F.explode("shards").alias("s")).select(F.col("s.index").alias("shard_index"), "s.filename", "s.tokens", "s.size_mb")
    return said.join(npy_shards.reconcile(spark, folder).select("shard_index", "agrees"), "shard_index")


@query(f"select '{{\"total_tokens\":' || sum(n)::bigint || ',\"total_shards\":' || count(*) || '}}' as summary, sum(n)::bigint as total_tokens from (select len(tokens) as n from ({SHARDS_SQL}))")
def manifest_json(spark: SparkSession, sf: str) -> DataFrame:
    totals = _sizes(spark, sf).agg(F.sum("tokens").alias("total_tokens"), F.count(F.lit(1)).alias("total_shards"))
    text = totals.select(F.to_json(F.struct("total_tokens", "total_shards")).alias("summary"))
    return text.select("summary", F.from_json("summary", "total_tokens bigint")["total_tokens"].alias("total_tokens"))


_TOKEN = "('0x' || substr(md5('42:' || p), 1, 8))::bigint % 32768"


@query(f"select shard_index, count(*)::bigint as n, sum(t)::bigint as total, min(t)::bigint as low, max(t)::bigint as high from (select p // 10000 as shard_index, {_TOKEN} as t from (select unnest(range(0, 40000)) as p)) group by 1")
def synthetic_shards(spark: SparkSession, sf: str) -> DataFrame:
    t = npy_shards.synthetic(spark).select("shard_index", F.explode("piece").alias("t"))
    return t.groupBy("shard_index").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("total"), F.min("t").cast("long").alias("low"), F.max("t").cast("long").alias("high"))


@query(f"select epoch::int as epoch, (row_number() over (partition by epoch order by md5('7:' || epoch || ':' || shard_index), shard_index) - 1)::int as place, shard_index from (select shard_index, unnest([0, 1, 2]) as epoch from ({SHARDS_SQL}))")
def shard_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return shards.shard_order(_sizes(spark, sf), 7, 3)


@query(f"with n as (select *, count(*) over () as k from ({NUMBERED_SQL})) select (epoch * k + rn - 10)::bigint as step, epoch::int as epoch, shard_index, win_index from n, (select unnest(range(0, 100)) as epoch) where epoch * k + rn - 10 between 0 and 2 * k + 4")
def epoch_wrap(spark: SparkSession, sf: str) -> DataFrame:
    """Two epochs and a bit, of which the first begins after ten windows."""
    w = stored(_windows(spark, sf).select("shard_index", "win_index"), "windows")
    return shards.epochs(w, 2 * w.count() + 5, skip=10).select("step", "epoch", "shard_index", F.col("win_index").cast("long").alias("win_index"))


@query(f"select row_number() over (order by shard_index) - 1 as place, printf('shard_%05d.npy', shard_index) as filename from ({SHARDS_SQL})")
def shard_files_sorted(spark: SparkSession, sf: str) -> DataFrame:
    files = shards.ordered_files(shards.named(_sizes(spark, sf)).select("filename"))
    return files.select((F.row_number().over(Window.orderBy("shard_index")) - 1).alias("place"), "filename")  # one row a shard


# ---- text files, logs, configurations


@query("select md5(text) as digest, count(*)::bigint as n from documents where length(coalesce(text, '')) >= 100 group by 1")
def corpus_dump_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "dump")
    corpus_text.dump(documents.min_length(documents.texts(docs(spark, sf), strict=True)), folder)
    return corpus_text.read_delimited(spark, folder).groupBy(F.md5(F.encode("text", "UTF-8")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select len(ids)::bigint as tokens, list_sum(list_transform(ids, lambda x, i: x::bigint * i))::bigint as checksum from ({ENC_SQL})")
def long_text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Documents from plain-text files that are read and encoded in pieces: a checksum of each document's ids in their order."""
    folder = new_folder(spark, "dump")
    corpus_text.dump(docs(spark, sf).select(F.coalesce("text", F.lit("")).alias("text")), folder)
    pieces = text_pieces.read_pieces(spark, folder, task_bytes=1 << 23, piece_bytes=1 << 16)
    return text_pieces.document_sums(text_pieces.encode_pieces(pieces, MERGES)).select("tokens", "checksum")


_LOG_SQL = "select event_id as step, case when event_id % 97 = 5 then 'nan'::double else value end as loss, case when event_id % 10 = 0 then value / 2 end as val_loss, 'x' as ts from events"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    step = F.col("event_id")
    rows = documents.read(spark, sf, "events").select(step.alias("step"), F.when(step % 97 == 5, F.lit(float("nan"))).otherwise(F.col("value")).alias("loss"), F.when(step % 10 == 0, F.col("value") / 2).alias("val_loss"))
    folder = new_folder(spark, "log")
    training_log.append(rows.filter("step % 2 = 0"), folder)
    training_log.append(rows.filter("step % 2 = 1"), folder)
    training_log.append(training_log.broken(rows.withColumn("event", F.lit(None).cast("string"))).select("event", "step", "loss"), folder)
    return training_log.read(spark, folder)


@query(f"select step, round(val_loss, 9) as val_loss from ({_LOG_SQL}) where val_loss is not null")
def log_evaluations(spark: SparkSession, sf: str) -> DataFrame:
    return training_log.evaluations(_log(spark, sf)).select("step", F.round("val_loss", 9).alias("val_loss"))


@query(f"select step, 'nan' as event from ({_LOG_SQL}) where loss is null or isnan(loss) or isinf(loss) union all select step, 'logged' from ({_LOG_SQL}) where loss is null or isnan(loss) or isinf(loss)")
def log_not_finite(spark: SparkSession, sf: str) -> DataFrame:
    """Steps without a finite loss, found again in the log's step rows and in the event rows that were written for them."""
    log = _log(spark, sf)
    return training_log.broken(log).select("step", "event").unionByName(log.filter("event is not null").select("step", F.lit("logged").alias("event")))


@query(f"select round(coalesce(avg(val_loss), 0), 9) as mean_value from (select * from ({_LOG_SQL}) where val_loss is not null order by step limit 50)")
def log_eval_mean(spark: SparkSession, sf: str) -> DataFrame:
    return training_log.mean_of_first(training_log.evaluations(_log(spark, sf)), "val_loss", "step", 50).select(F.round("mean_value", 9).alias("mean_value"))


@query("""with e as (select user_id, event_id, epoch(ts) as t, row_number() over w as n, epoch(ts) - lag(epoch(ts)) over w as seconds, epoch(ts) - first(epoch(ts)) over w as elapsed from events window w as (partition by user_id order by ts, event_id))
select user_id, event_id, round(seconds, 3) as seconds, round(case when seconds > 0 then 131072 / seconds end, 3) as tokens_per_second, round(100.0 * n * 131072 / 1e9, 6) as percent,
round(case when elapsed > 0 then greatest(0, (1e9 - n * 131072) / ((n - 1) * 131072 / elapsed)) end, 1) as seconds_to_go from e""")
def log_throughput(spark: SparkSession, sf: str) -> DataFrame:
    rows = training_log.throughput(documents.read(spark, sf, "events"), "user_id", "event_id", "ts", 131_072, 1_000_000_000)
    return rows.select("user_id", "event_id", F.round("seconds", 3).alias("seconds"), F.round("tokens_per_second", 3).alias("tokens_per_second"), F.round("percent", 6).alias("percent"), F.round("seconds_to_go", 1).alias("seconds_to_go"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, floor(epoch(ts))::bigint as seconds from events")
def log_dates(spark: SparkSession, sf: str) -> DataFrame:
    iso = documents.read(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))
    return iso.select("event_id", "iso", F.unix_timestamp(F.to_timestamp("iso", "yyyy-MM-dd'T'HH:mm:ss")).alias("seconds"))


@query(f"select name, target_params::bigint as target_params, n_layers::int as n_layers, d_model::int as d_model, theta_base::double as theta_base from {_PRESETS_SQL}")
def model_configs(spark: SparkSession, sf: str) -> DataFrame:
    return configs.models(spark, kernels.PRESET_SCHEMA).select("name", "target_params", "n_layers", "d_model", "theta_base")


_LEAF_SQL = f"""select name, module, leaf, rows::bigint as rows, cols::bigint as cols from {_PRESETS_SQL}, lateral (
select 'tok_emb' as module, 'embedding' as leaf, vocab_size as rows, d_model as cols union all select 'norm_final', 'scale', d_model, 1 union all
select 'block_' || i, l.leaf, l.r, l.c from (select unnest(range(0, n_layers)) as i), lateral (select * from (values ('attn/wq', d_model, d_model), ('attn/wk', d_model, (d_model // n_heads) * n_kv_heads), ('attn/wv', d_model, (d_model // n_heads) * n_kv_heads),
('attn/wo', d_model, d_model), ('mlp/w_gate', d_model, d_ff), ('mlp/w_up', d_model, d_ff), ('mlp/w_down', d_ff, d_model), ('norm_attn/scale', d_model, 1), ('norm_mlp/scale', d_model, 1)) v(leaf, r, c)) l)"""


@query(f"select name, module, sum(rows * cols)::bigint as params from ({_LEAF_SQL}) group by rollup (name, module) having name is not null")
def params_by_module(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters by module, and by model (module null)."""
    return kernels.parameters(kernels.presets(spark)).rollup("name", "module").agg(F.sum(F.col("rows") * F.col("cols")).alias("params")).filter("name is not null")


@query(f"select module || '/' || leaf as param, case when leaf = 'attn/wq' then 'shape' else 'missing' end as problem from ({_LEAF_SQL}) where name = '25m' and (leaf = 'attn/wq' or module = 'block_3') and not (module = 'block_3' and leaf = 'attn/wq') union all select 'block_3/attn/wq', 'missing' union all select 'lm_head/kernel', 'unexpected'")
def key_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """What a set of saved parameters lacks, has in another shape, or has beside the model's."""
    model = kernels.parameters(kernels.presets(spark)).filter("name = '25m'").select(F.concat_ws("/", "module", "leaf").alias("param"), "rows", "cols")
    saved = model.filter("param not like 'block_3/%'").withColumn("rows", F.when(F.col("param").endswith("attn/wq"), F.col("rows") + 1).otherwise(F.col("rows")))
    saved = saved.select(F.concat(F.lit("params/"), "param").alias("param"), "rows", "cols").unionByName(spark.createDataFrame([("params/lm_head/kernel", 512, 32768)], "param string, rows bigint, cols bigint"))
    return kernels.reconcile(model, saved)


_W = 8


@query(f"""with e as (select vec_id, {_E} as e from embeddings),
h as (select vec_id, j, list_sum(list_transform(range(1, 65), lambda i: e[i] * cos(i + 3 * j))) as g, list_sum(list_transform(range(1, 65), lambda i: e[i] * sin(2 * i + j))) as u from e, (select unnest(range(1, {_W + 1})) as j)),
a as (select vec_id, list(g / (1 + exp(-g)) * u order by j) as a from h group by vec_id)
select vec_id, k::int as k, round(list_sum(list_transform(range(1, {_W + 1}), lambda j: a[j] * cos(j * k))), 4) + 0.0 as value from a, (select unnest(range(1, 65)) as k)""")
def swiglu_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    import math

    gate = [[math.cos(i + 3 * j) for i in range(1, 65)] for j in range(1, _W + 1)]
    up = [[math.sin(2 * i + j) for i in range(1, 65)] for j in range(1, _W + 1)]
    down = [[math.cos(j * k) for j in range(1, _W + 1)] for k in range(1, 65)]
    out = kernels.swiglu(F.col("embedding"), gate, up, down)
    return documents.read(spark, sf, "embeddings").select("vec_id", F.posexplode(out).alias("i", "v")).select("vec_id", (F.col("i") + 1).alias("k"), (F.round("v", 4) + 0.0).alias("value"))


def _adamw_sql(steps: int) -> str:
    """The steps written out: gradients are the vector reversed, times the step's number."""
    g = "e[len(e) + 1 - i]"
    p = "e[i]"
    for t in range(1, steps + 1):
        m = " + ".join(f"{0.1 * 0.9 ** (t - k)!r} * {k} * {g}" for k in range(1, t + 1))
        v = " + ".join(f"{(1 - 0.95) * 0.95 ** (t - k)!r} * {k * k} * {g} * {g}" for k in range(1, t + 1))
        p = f"({p} - 3e-4 * (({m}) / {1 - 0.9**t!r} / (sqrt(({v}) / {1 - 0.95**t!r}) + 1e-8) + 0.1 * {p}))"
    return f"list_transform(range(1, len(e) + 1), lambda i: {p})"


@query(_vector_sql(_adamw_sql(3)))
def adamw_steps(spark: SparkSession, sf: str) -> DataFrame:
    grad = F.reverse(kernels.doubles(F.col("embedding")))
    grads = F.array(*[kernels.scaled(grad, k) for k in (1, 2, 3)])
    return _vector(documents.read(spark, sf, "embeddings"), kernels.adamw(F.col("embedding"), grads, 3e-4, 0.1))


@query("select round(avg(loss), 6) as mean_loss, round(exp(avg(loss)), 6) as perplexity from (" + SQL["log_softmax_ce"] + ")")
def mean_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    loss = F.avg(F.round(kernels.cross_entropy(F.col("embedding"), F.expr("label % size(embedding)")), 6))
    return documents.read(spark, sf, "embeddings").agg(F.round(loss, 6).alias("mean_loss"), F.round(F.exp(loss), 6).alias("perplexity"))


_TINY = {"n_layers": 2, "d_model": 32, "n_heads": 4, "n_kv_heads": 2, "d_ff": 64, "vocab_size": FIRST_MERGE + len(MERGES), "theta_base": 10000.0}


@query()
def lm_window_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Loss of each training window under a small untrained model whose parameters went through a file: near ln(325). Matrices and a forward
    pass are not for SQL; tests hold it against the formulas written out."""
    folder = new_folder(spark, "model")
    safetensors.export(model.init(_TINY, 42), {"vocab_size": _TINY["vocab_size"]}, folder)
    w = model.evaluate(_windows(spark, sf), safetensors.load(f"{folder}/model.safetensors"), _TINY)
    return w.select("shard_index", F.col("win_index").cast("long").alias("win_index"), F.round("loss", 4).alias("loss"))


@query("select 'block_' || i || '/' || leaf as name, cols::bigint as size from (select unnest([0, 1]) as i), (values ('attn/wq', 1024), ('attn/wk', 512), ('attn/wv', 512), ('attn/wo', 1024), ('mlp/w_gate', 2048), ('mlp/w_up', 2048), ('mlp/w_down', 2048), ('norm_attn/scale', 32), ('norm_mlp/scale', 32)) v(leaf, cols) union all select 'norm_final/scale', 32 union all select 'tok_emb/embedding', " + str(_TINY["vocab_size"] * 32))
def tensor_scan(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "model")
    safetensors.export(model.init(_TINY, 42), {}, folder)
    return safetensors.scan(spark, f"{folder}/model.safetensors").select("name", "size")


#: A public merge table for the largest vocabulary of the id layout; the query is there where the file is.
PUBLIC_TABLE = os.environ.get("SPARKLOOM_PUBLIC_BPE", "/opt/tokenizers/byte_bpe_50k.json")


def bpe_encode_docs_32k(spark: SparkSession, sf: str) -> DataFrame:
    """All 32,507 merges that the id layout holds. Too many for SQL: tests hold it against the greedy rule."""
    e = bpe.encode_documents(docs(spark, sf), bpe.from_byte_level(PUBLIC_TABLE))
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join("ids", ",")).alias("digest"))


if os.path.exists(PUBLIC_TABLE):
    query()(bpe_encode_docs_32k)

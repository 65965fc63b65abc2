"""Commands: python -m sparkloom.cli shards | train | dump | params. Paths may be URIs; documents are Parquet with doc_id and text."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import bpe, documents, kernels
from sparkloom.sources import corpus_text, npy_shards


def _documents(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    docs = documents.texts(spark.read.parquet(args.documents), args.text_field, args.id_field)
    if args.char_budget is None:
        return documents.min_length(docs, args.min_doc_len).select("doc_id", "text")
    return documents.char_budget(docs, args.char_budget, args.min_doc_len).select("doc_id", "text")


def shards(spark: SparkSession, args: argparse.Namespace) -> None:
    """Documents to token shards with a manifest."""
    docs = documents.texts(spark.read.parquet(args.documents), args.text_field, args.id_field)
    kept, merges = documents.min_length(docs, args.min_doc_len), bpe.load(args.tokenizer)
    if args.token_budget is not None:
        kept = documents.least_tokens(kept, args.token_budget, max(map(len, bpe.vocabulary(merges).values())))
    m = npy_shards.write_documents(bpe.encode_documents(kept, merges), args.output_dir, args.shard_size, args.dataset_version, token_budget=args.token_budget, resume=args.skip_existing)
    print(f"{m['total_tokens']} tokens in {m['total_shards']} shards")


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    """Documents to a tokenizer."""
    merges = bpe.train(documents.non_empty(_documents(spark, args)), args.vocab_size)
    print(f"{len(merges)} merges in {bpe.save(merges, args.output_dir, overwrite=args.overwrite)}")


def dump(spark: SparkSession, args: argparse.Namespace) -> None:
    """Documents to plain text with a marker between them."""
    corpus_text.dump(_documents(spark, args), args.output_dir)


def params(spark: SparkSession, args: argparse.Namespace) -> None:
    """Parameters of a model preset by module."""
    rows = kernels.parameters(kernels.presets(spark).filter(F.col("name") == args.name))
    for r in rows.groupBy("module").agg(F.sum(F.col("rows") * F.col("cols")).alias("n")).orderBy("module").collect():  # a row a module
        print(f"{r['module']:<12} {r['n']}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    commands = top.add_subparsers(required=True)
    whole = lambda x: int(float(x))  # noqa: E731  10e9 is a whole number, too
    for run in (shards, train, dump, params):
        p = commands.add_parser(run.__name__, help=run.__doc__)
        p.set_defaults(run=run)
        if run is params:
            p.add_argument("--name", default="25m")
            continue
        p.add_argument("--documents", required=True)
        p.add_argument("--output-dir", required=True)
        p.add_argument("--text-field", default="text")
        p.add_argument("--id-field", default="doc_id")
        p.add_argument("--min-doc-len", type=int, default=0 if run is train else 100)
        if run is shards:
            p.add_argument("--tokenizer", required=True)
            p.add_argument("--token-budget", type=whole)
            p.add_argument("--shard-size", type=whole, default=50_000_000)
            p.add_argument("--dataset-version", default=npy_shards.VERSION)
            p.add_argument("--skip-existing", action="store_true")
        else:
            p.add_argument("--char-budget", type=whole)
        if run is train:
            p.add_argument("--vocab-size", type=int, default=bpe.MAX_VOCAB)
            p.add_argument("--overwrite", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName("sparkloom").getOrCreate(), args)


if __name__ == "__main__":
    main()

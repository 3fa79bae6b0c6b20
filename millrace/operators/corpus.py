"""Corpus preparation from sources to shards."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import tokenizer_sources
from millrace.functions.holdout import content_bucket
from millrace.functions.text import CleanRules
from millrace.operators import mixture
from millrace.operators.budget import cut_to_budget
from millrace.operators.tokenizer import encode
from millrace.plans.prefix import joined_back
from millrace.plans.scratch import discard, materialize
from millrace.sources.readers import Source, read_sources
from millrace.sources.sinks import commit_shards, manifest, shard_name, write_manifest


@dataclass(frozen=True)
class CorpusSpec:
    """What a corpus is cut to.  ``max_tokens`` needs ``tokenizer``."""

    split: str = "train"
    holdout_mod: int = 100
    seed: int = 0
    shuffle: str = "hash"
    shuffle_buffer: int = 10_000
    unit: str = "chars"
    weighting: str = "stride"
    max_bytes: int | None = None
    max_tokens: int | None = None
    tokenizer: str | None = None
    per_shard: int = 100_000
    rules: CleanRules = field(default_factory=CleanRules)


def measured(docs: DataFrame, spec: CorpusSpec) -> DataFrame:
    """source, ord, n_chars, n_bytes, bucket and, with a tokenizer, n_tokens: all that selection looks at, made once."""
    if spec.max_tokens is not None and not spec.tokenizer:
        raise ValueError("a token budget needs a tokenizer")
    text = F.col("text")
    tokens = [F.size(encode(text, spec.tokenizer)).cast("long").alias("n_tokens")] if spec.tokenizer else []
    rows = docs.select("source", "ord", F.length(text).cast("long").alias("n_chars"), F.octet_length(text).cast("long").alias("n_bytes"), content_bucket(text, spec.holdout_mod).alias("bucket"), *tokens)
    return materialize(rows, "corpus-lengths")


def select_corpus(docs: DataFrame, weights: dict[str, float], spec: CorpusSpec) -> DataFrame:
    """Mixture, then split, then budget, the order in which running lengths see rows: (source, ord) of what stays, with ``pos`` and lengths, without texts."""
    rows = measured(docs, spec)
    length = F.lit(1) if spec.weighting == "document" or spec.unit == "documents" else F.col({"chars": "n_chars", "bytes": "n_bytes"}[spec.unit])
    sized = rows.withColumn("len", length.cast("long"))
    mixed = mixture.replay(sized, weights, spec.seed) if spec.weighting == "replay" else mixture.stride(sized, weights)
    if spec.split not in ("all", "train", "val"):
        raise ValueError(f"split is all, train or val, not {spec.split!r}")
    if spec.split != "all":
        mixed = mixed.where((F.col("bucket") == 0) == F.lit(spec.split == "val"))
    limits = {c: n for c, n in (("n_bytes", spec.max_bytes), ("n_tokens", spec.max_tokens)) if n is not None}
    return cut_to_budget(mixed, ["pos"], limits) if limits else mixed


def prepare_corpus(spark: SparkSession, sources: list[Source], folder: str, spec: CorpusSpec) -> dict:
    """Writes shards and a manifest; returns the manifest.

    Texts are written twice: cleaned, and in the shards.  What lies between sees
    keys and lengths.
    """
    if spec.max_tokens is not None and not spec.tokenizer:
        raise ValueError("a token budget needs a tokenizer")
    docs = materialize(read_sources(spark, sources, spec.rules, spec.seed, spec.shuffle_buffer, spec.shuffle), "corpus-texts", "zstd")
    chosen = materialize(select_corpus(docs, {s.name: s.weight for s in sources}, spec), "corpus")
    shards = commit_shards(joined_back(docs, chosen.select("source", "ord", "pos"), ["source", "ord"], unique=True), folder, ["pos"], spec.per_shard)
    sums = [F.count(F.lit(1)).alias("docs"), *[F.coalesce(F.sum(f"n_{k}"), F.lit(0)).alias(k) for k in ("bytes", "chars", *(["tokens"] if spec.tokenizer else []))]]
    total = chosen.agg(*sums).first().asDict()
    listed = sorted(tuple(r) for r in shards.select("shard", "sha256").collect())  # what the manifest names
    files = [shard_name(folder, k) for k, _ in listed]
    info = {
        "sources": [{"name": s.name, "path": s.path, "text_key": s.text_key, "revision": s.revision, "subset": s.subset, "weight": s.weight, "split": s.split} for s in sources],
        "sampling_seed": spec.seed,
        "shuffle": {"kind": spec.shuffle, "seed": spec.seed, "buffer_size": spec.shuffle_buffer},
        "mixture": {"weighting": spec.weighting, "unit": spec.unit},
        "holdout": {"role": spec.split, "method": "sha256 of the cleaned text", "holdout_mod": spec.holdout_mod},
        "min_chars": spec.rules.min_chars,
        "docs_per_shard": spec.per_shard,
    }
    content = manifest(spark, files, info, total, {f.rsplit("/", 1)[-1]: digest for f, (_, digest) in zip(files, listed)})
    write_manifest(spark, folder, content)
    discard(docs, chosen)
    return content


# The two public sets that corpora are made of, and what each corpus takes of them.
ENGLISH = {"name": "HuggingFaceFW/fineweb-edu", "subset": "default"}
KOREAN = {"name": "HuggingFaceFW/fineweb-2", "subset": "kor_Hang"}
#: Shares of English and Korean; train and validation tokens; what is added to the seed for validation; who is validated in full.
RECIPES = {
    "architecture": {"shares": {"en": 0.95, "ko": 0.05}, "tokens": 300_000_000, "val_tokens": 10_000_000, "val_seed": 1, "first": "en"},
    "pretraining": {"shares": {"en": 0.95, "ko": 0.05}, "tokens": 11_500_000_000, "val_tokens": 20_000_000, "val_seed": 7, "first": "en"},
    "continued": {"shares": {"en": 0.30, "ko": 0.70}, "tokens": 2_000_000_000, "val_tokens": 10_000_000, "val_seed": 3, "first": "ko"},
}
TOKENIZER_GB = 20.0


def default_sources() -> list[Source]:
    """What a tokenizer is trained on unless a file says otherwise."""
    return [Source(**ENGLISH, weight=0.75), Source(**KOREAN, weight=0.25)]


def tokenizer_recipe(config: str | None = None, gb: float | None = None, seed: int = 42) -> tuple[list[Source], CorpusSpec]:
    """Sources and spec of the tokenizer's corpus: all splits, cut at so many bytes; from a tokenizer YAML file if given."""
    sources, wanted = (default_sources(), TOKENIZER_GB) if config is None else tokenizer_sources(config)
    return sources, CorpusSpec(split="all", seed=seed, max_bytes=int((wanted if gb is None else gb) * 1e9))


def recipe(name: str, seed: int = 42, tokenizer: str | None = None, tokens: float | None = None, val_tokens: int | None = None, paths: dict[str, str] | None = None) -> dict[str, tuple[list[Source], CorpusSpec]]:
    """By (split_language): the one source and the spec of each part of the named corpus.

    Each language has a token budget of its own, its share of ``tokens``; the second
    language is validated on half as many tokens as the first.  ``paths`` gives local
    globs by language, otherwise sources are looked up in the mirror.
    """
    r = RECIPES[name]
    whole, held = int(r["tokens"] if tokens is None else tokens), r["val_tokens"] if val_tokens is None else val_tokens
    parts = {}
    for lang, share in r["shares"].items():
        source = [Source(**(ENGLISH if lang == "en" else KOREAN), path=(paths or {}).get(lang))]
        for split, limit, at in (("train", int(whole * share), seed), ("val", held if lang == r["first"] else held // 2, seed + r["val_seed"])):
            parts[f"{split}_{lang}"] = source, CorpusSpec(split=split, seed=at, max_tokens=limit, tokenizer=tokenizer)
    return parts


def prepare_recipe(spark: SparkSession, parts: dict[str, tuple[list[Source], CorpusSpec]], folder: str) -> dict[str, dict]:
    """Each part of a recipe in a folder of its own; their manifests."""
    return {name: prepare_corpus(spark, sources, f"{folder}/{name}", spec) for name, (sources, spec) in parts.items()}

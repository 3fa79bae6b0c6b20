"""Byte-level BPE: pre-tokens as a column, training from their counts, encoding by Arrow."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import TokenizerConfig
from millrace.functions.text import word_count
from millrace.operators.bpe import learn_merges
from millrace.sources.sinks import write_text

#: Fixed value: the pre-token rule of byte-level BPE, with Unicode classes on.
PRE_TOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Special tokens in their fixed order; the rest of the reserved block is numbered.
SPECIALS = ["<|bos|>", "<|eos|>", "<|pad|>", "<|system|>", "<|user|>", "<|assistant|>", "<|turn_end|>"]
RESERVED = 16
#: Texts that the library encodes at once: what it keeps beside the ids is many times a text.
ENCODE_ROWS = 64
#: The rule with the Unicode letters, numbers and white space below U+0250 spelled out, and what it does not cover.
LOW_LETTERS, LOW_NUMBERS, LOW_SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \u0085\u00a0"
LOW_RULE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LOW_LETTERS}]+| ?[{LOW_NUMBERS}]+| ?[^{LOW_SPACES}{LOW_LETTERS}{LOW_NUMBERS}]+|[{LOW_SPACES}]+(?![^{LOW_SPACES}])|[{LOW_SPACES}]+")
NOT_LOW = re.compile("[^\x00-ɏ]")
#: Pre-tokens in each of a worker's two generations; a memory bound, not a limit of the result.
REMEMBERED = 300_000


def special_tokens() -> list[str]:
    return SPECIALS + [f"<|reserved_{k}|>" for k in range(RESERVED)]


def special_tokens_map() -> dict:
    """What tools expect beside a tokenizer file."""
    begin, end, pad, *more = special_tokens()
    return {"bos_token": begin, "eos_token": end, "pad_token": pad, "additional_special_tokens": more}


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0))


def piece_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """piece, n: how often each pre-token comes; counted map-side before the shuffle."""
    return docs.select(F.explode(pre_tokens(F.col(text_col))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def train_bpe(docs: DataFrame, vocab_size: int, min_frequency: int = 2, text_col: str = "text") -> str:
    """JSON of a byte-level BPE of exactly ``vocab_size`` entries: specials first, then bytes, then merges.

    The corpus is reduced to its piece counts, and ``bpe.learn_merges`` learns from all
    of them in rounds; neither texts nor pieces come to the driver as a whole.
    """
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, processors

    specials = special_tokens()
    learned, merges = learn_merges(piece_counts(docs, text_col), vocab_size - len(specials), min_frequency)
    vocab = {s: k for k, s in enumerate(specials)} | {name: k + len(specials) for name, k in learned.items()}
    tok = Tokenizer(models.BPE(vocab=vocab, merges=merges, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tok.decoder = decoders.ByteLevel()
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    tok.add_special_tokens(specials)
    if tok.get_vocab_size() != vocab_size:
        raise ValueError(f"the corpus gives {tok.get_vocab_size()} entries, not {vocab_size}")
    return tok.to_str()


def save_tokenizer(spark: SparkSession, spec: str, folder: str, config: TokenizerConfig) -> list[str]:
    """The tokenizer, its vocabulary, its merges and what tools expect beside them, as files; a vocabulary of another size is an error."""
    require_vocab(spec, config.vocab_size)
    tok = _loaded(spec, False)
    if lacking := [s for s in special_tokens() if tok.token_to_id(s) is None]:
        raise ValueError(f"no id for {', '.join(lacking)}")
    model = json.loads(tok.to_str())["model"]
    pairs = [p if isinstance(p, list) else p.split(" ", 1) for p in model["merges"]]
    settings = {"vocab_size": config.vocab_size, "min_frequency": config.min_frequency, "seed": config.seed, "special_tokens": special_tokens(), "input_files": config.input_files}
    pretty = lambda value: json.dumps(value, ensure_ascii=False, indent=2)
    files = {
        "tokenizer.json": tok.to_str(pretty=True),
        "vocab.json": json.dumps(dict(sorted(model["vocab"].items(), key=lambda kv: kv[1])), ensure_ascii=False, separators=(",", ":")),
        "merges.txt": "#version: 0.2\n" + "".join(f"{a} {b}\n" for a, b in pairs),
        "special_tokens_map.json": pretty(special_tokens_map()),
        "tokenizer_config.json": pretty({"tokenizer_class": "PreTrainedTokenizerFast", "model_max_length": 1024, **special_tokens_map()}),
        "training_config.json": pretty(settings),
    }
    for name, text in files.items():
        write_text(spark, f"{folder}/{name}", text)
    return sorted(files)


def train_from_config(spark: SparkSession, config: TokenizerConfig) -> str:
    """Trains on the files of a tokenizer run and saves what it needs; the tokenizer's JSON."""
    from millrace.sources.readers import read_training_files

    spec = train_bpe(read_training_files(spark, config.input_files, config.text_key), config.vocab_size, config.min_frequency)
    save_tokenizer(spark, spec, config.output_dir, config)
    return spec


@lru_cache(maxsize=4)
def _loaded(spec: str, plain_specials: bool):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec) if spec.lstrip().startswith("{") else Tokenizer.from_file(spec)
    tok.encode_special_tokens = plain_specials
    return tok


def _by_piece(spec: dict) -> bool:
    """Whether ids of a text are those of its pre-tokens in a row: byte-level BPE without another step, all added tokens special."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(spec.get(x) for x in ("normalizer", "truncation", "padding")) and all(x["special"] for x in spec.get("added_tokens", []))
    bytewise = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return plain and bytewise and model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))


class PieceIds:
    """Packed ids of texts whose special strings are ordinary text; the library encodes each distinct pre-token once.

    Texts with characters from U+0250 on, and all texts of a tokenizer of another
    build, go through the library whole.
    """

    def __init__(self, spec: str):
        self.spec = spec
        self.by_piece = _by_piece(json.loads(_loaded(spec, True).to_str()))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def by_library(self, texts: list[str]) -> list[bytes]:
        tok = _loaded(self.spec, True)
        return [np.array(e.ids, "<i4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def packed(self, texts: list[str]) -> list[bytes]:
        cut = [LOW_RULE.findall(t) if self.by_piece and not NOT_LOW.search(t) else None for t in texts]
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = set().union(*[p for p in cut if p]).difference(known)
        known.update((p, older[p]) for p in new if p in older)
        fresh = list(new.difference(older))
        known.update(zip(fresh, self.by_library(fresh)))
        whole = iter(self.by_library([t for t, p in zip(texts, cut) if p is None]))
        return [next(whole) if p is None else b"".join(map(known.__getitem__, p)) for p in cut]


@lru_cache(maxsize=2)
def _piece_ids(spec: str) -> PieceIds:
    """One per worker process and tokenizer."""
    return PieceIds(spec)


def encode(text: Column, spec: str, allow_special: bool = False) -> Column:
    """Ids of a text; strings of special tokens in it are ordinary text unless allowed.

    ``spec`` is a tokenizer's JSON or the path of its file, the same on all machines.
    """

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        rows = texts.fillna("").tolist()
        groups = (rows[i : i + ENCODE_ROWS] for i in range(0, len(rows), ENCODE_ROWS))
        if not allow_special:
            return pd.Series([np.frombuffer(x, "<i4") for g in groups for x in _piece_ids(spec).packed(g)], dtype=object)
        tok = _loaded(spec, False)
        return pd.Series([np.array(e.ids, "int32") for g in groups for e in tok.encode_batch_fast(g, add_special_tokens=False)], dtype=object)

    return run(text)


def encode_document(text: Column, spec: str, begin: int, end: int) -> Column:
    return F.concat(F.array(F.lit(begin)), encode(text, spec), F.array(F.lit(end)))


def decode(ids: Column, spec: str, skip_special: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        tok = _loaded(spec, False)
        return pd.Series(tok.decode_batch([list(map(int, r)) for r in rows], skip_special_tokens=skip_special))

    return run(ids)


def vocabulary(spark, spec: str) -> DataFrame:
    """token, id."""
    rows = sorted(_loaded(spec, False).get_vocab(with_added_tokens=True).items(), key=lambda kv: kv[1])
    return spark.createDataFrame(rows, "token string, id int")


def vocabulary_ids(spec: str, tokens: Sequence[str]) -> list[int]:
    """Ids of tokens; one that is missing is an error."""
    ids = [_loaded(spec, False).token_to_id(t) for t in tokens]
    if None in ids:
        raise ValueError(f"no id for {tokens[ids.index(None)]}")
    return ids


def merges(spark, spec: str) -> DataFrame:
    """rank, left, right."""
    pairs = json.loads(_loaded(spec, False).to_str())["model"]["merges"]
    return spark.createDataFrame([(k, *(p if isinstance(p, list) else p.split(" ", 1))) for k, p in enumerate(pairs)], "rank int, left string, right string")


def require_vocab(spec: str, size: int) -> None:
    have = _loaded(spec, False).get_vocab_size()
    if have != size:
        raise ValueError(f"the tokenizer has {have} entries, the model {size}")


def single_character_tokens(spec: str) -> list[int]:
    """Ids that decode to one character: the number of ids bounds the list."""
    tok = _loaded(spec, False)
    return [i for i in range(tok.get_vocab_size()) if len(tok.decode([i], skip_special_tokens=False)) == 1]


def token_statistics(text: Column, spec: str) -> Column:
    """Struct of a text's number of tokens and of those that decode to one character."""
    single = np.zeros(_loaded(spec, False).get_vocab_size(), dtype=bool)
    single[single_character_tokens(spec)] = True

    @F.pandas_udf("n_tokens long, n_single long")
    def run(texts: pd.Series) -> pd.DataFrame:
        tok = _loaded(spec, True)
        rows = texts.fillna("").tolist()
        ids = (np.array(e.ids, dtype=np.int64) for i in range(0, len(rows), ENCODE_ROWS) for e in tok.encode_batch_fast(rows[i : i + ENCODE_ROWS], add_special_tokens=False))
        return pd.DataFrame([(len(x), int(single[x].sum())) for x in ids], columns=["n_tokens", "n_single"])

    return run(text)


def corpus_statistics(docs: DataFrame, spec: str, text_col: str = "text") -> DataFrame:
    """One row: documents, characters, words, tokens and one-character tokens, summed in parts, and their ratios with denominators of 1 at least."""
    each = docs.select(F.length(text_col).cast("long").alias("chars"), word_count(F.col(text_col)).alias("words"), token_statistics(F.col(text_col), spec).alias("t"))
    sums = each.agg(F.count(F.lit(1)).alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("chars", "chars"), ("words", "words"), ("t.n_tokens", "tokens"), ("t.n_single", "single"))])
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return sums.select(
        "documents", "chars", "words", "tokens", over("tokens", "words").alias("tokens_per_word"), over("tokens", "chars").alias("tokens_per_char"),
        (F.greatest(F.col("chars"), F.lit(1)) / F.greatest(F.col("tokens"), F.lit(1))).alias("compression_ratio_char_per_token"),
        over("tokens", "documents").alias("avg_sequence_length"), over("single", "tokens").alias("single_char_token_fraction"),
    )


#: Texts whose ids are shown in an evaluation.
SAMPLE_TEXTS = ["The quick brown fox jumps over the lazy dog.", "안녕하세요, 반갑습니다.", "def add(a, b):\n    return a + b", "A mixed 문장 with 123 numbers."]


def evaluate_tokenizer(spark: SparkSession, spec: str, corpora: Mapping[str, DataFrame], samples: Sequence[str] = SAMPLE_TEXTS, output: str | None = None) -> dict:
    """Ratios by corpus, whether each named special is one id, and exact round trips of the samples; written as JSON if a path is given."""
    plain, marked = _loaded(spec, True), _loaded(spec, False)
    plain.encode_special_tokens, marked.encode_special_tokens = True, False
    size = marked.get_vocab_size()
    result: dict = {"vocab_size": size, "embedding_parameters": size}
    result["special_tokens_single_id"] = {s: marked.encode(s, add_special_tokens=False).ids == [marked.token_to_id(s)] for s in SPECIALS}
    for name, docs in corpora.items():
        result[name] = {k: v for k, v in corpus_statistics(docs, spec).first().asDict().items() if k not in ("chars", "words")}
    ids = [plain.encode(s, add_special_tokens=False).ids for s in samples]
    result["qualitative"] = [{"text": s, "ids": i, "n_tokens": len(i), "roundtrip_ok": plain.decode(i, skip_special_tokens=False) == s} for s, i in zip(samples, ids)]
    if output:
        write_text(spark, output, json.dumps(result, ensure_ascii=False, indent=2))
    return result


def round_trip(docs: DataFrame, spec: str, text_col: str = "text") -> DataFrame:
    """Adds ``ids`` and whether decoding gives the text back."""
    out = docs.withColumn("ids", encode(F.col(text_col), spec))
    return out.withColumn("exact", decode(F.col("ids"), spec) == F.col(text_col))

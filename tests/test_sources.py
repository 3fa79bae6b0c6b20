import hashlib
import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.config import RunConfig, TokenizerConfig, may_resume
from millrace.functions.text import CleanRules
from millrace.operators import bpe, ordering, tokenizer
from millrace.operators.corpus import CorpusSpec, prepare_corpus, prepare_recipe, recipe, tokenizer_recipe
from millrace.sources import readers
from millrace.sources.files import move_once
from millrace.sources.sinks import commit_shards, keep_newest, read_text, write_shards, write_text


@pytest.fixture()
def shards(tmp_path):
    for s in range(4):
        lines = [json.dumps({"text": f"document number {s * 125 + i} with enough characters to pass cleaning"}) for i in range(125)]
        (tmp_path / f"in_{s}.jsonl").write_text("\n".join(lines) + "\n")
    return tmp_path


def test_jsonl_edge_cases(spark, tmp_path):
    lines = ['{"text": "good one"}', "", "not json", '{"other": 1}', '{"text": ""}', '{"text": null}', '{"text": "half \\ud800 pair"}', '{"text": "whole \\ud83d\\ude00 pair"}', '["x"]', "   "]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    got = sorted(r.text for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect())
    assert got == ["good one", "whole \U0001f600 pair"]


def test_jsonl_is_strict(spark, tmp_path):
    """Each line as the standard parser takes it, but that a text with half a UTF-16 pair is left out."""
    lines = [
        r'{"text": "C:\\udcab is a folder"}', r'{"text":"ok","other":"\ud800"}', r'{"text": "C:\\\udcab half"}', r'{"text": "\ud83d\ude00 \ud83d"}', r'{"text": "\\\\ud83d kept \u00e9"}',
        "{'text': 'single'}", '{"text": "a"} trailing', '{"text": "a"}, {"text": "b"}', '{"text": "a"}, 1', '{"text": "a"}]', '{"text": "a"}, "z": 1', '[{"text": "in a list"}]', '"text"', "null", "{}",
        '{"text": "twice", "text": "the last"}', '{"other": {"text": "inner"}, "text": "outer", "list": [1, {"text": 2}]}', ' \t{"text": "blanks"} \t', '{"text": "tab\there"}', '{"text": "a",}', "{text: 1}", '{"text": "open',
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))

    def standard(line):
        try:
            text = json.loads(line).get("text")
            text.encode()
            return text
        except (ValueError, AttributeError):
            return None

    want = [t for t in map(standard, lines) if t]
    assert len(want) == 6 and sorted(r.text for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()) == sorted(want)


@pytest.mark.parametrize("kind", ["jsonl", "parquet"])
def test_order_by_seed_does_not_depend_on_the_layout(spark, tmp_path, kind):
    """Equal orders in two folders, with files in one split and in many."""
    texts = {f"{d}/f{k}": [f"text {d} {k} {i} {'x' * (i % 50)}" for i in range(200)] for d in ("p", "q r") for k in range(2)}
    orders = []
    for folder, size in (("one", 1 << 27), ("other/deep er", 1 << 12)):
        for name, rows in texts.items():
            file = tmp_path / folder / f"{name}.{kind}"
            file.parent.mkdir(parents=True, exist_ok=True)
            if kind == "jsonl":
                file.write_text("\n\n".join(json.dumps({"text": t}) for t in rows) + "\n")
            else:
                pq.write_table(pa.table({"text": rows}), file, row_group_size=32)
        held = [spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        try:
            found = readers.read_sources(spark, [readers.Source("s", path=f"{tmp_path}/{folder}/*/*.{kind}")], seed=5, buffer_size=40)
            assert size > 1 << 20 or kind == "parquet" or found.rdd.getNumPartitions() > 8
            orders.append([r.text for r in found.orderBy("ord").collect()])
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
            spark.conf.set("spark.sql.files.openCostInBytes", held[1])
    assert orders[0] == orders[1] and sorted(orders[0]) == sorted(t for rows in texts.values() for t in rows) and orders[0] != sorted(orders[0])


def test_dispatch_and_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_source(spark, readers.Source("s", path=f"{tmp_path}/none/*.jsonl"))
    spark.createDataFrame([(f"text {i}",) for i in range(6)], "text string").coalesce(1).write.parquet(f"{tmp_path}/p")
    assert readers.read_source(spark, readers.Source("s", path=f"{tmp_path}/p/part-*")).count() == 6
    (tmp_path / "x.txt").write_text("one\n\n two \n")
    (tmp_path / "y.jsonl").write_text('{"text": "three"}\n')
    assert sorted(r.text for r in readers.read_training_text(spark, f"{tmp_path}/*.*").collect()) == [" two ", "one", "three"]
    with pytest.raises(ValueError):
        readers.read_source(spark, readers.Source("s"))


def test_source_shuffle_keeps_all(spark, shards):
    src = readers.Source("s", path=f"{shards}/in_*.jsonl")
    plain = [r.text for r in readers.read_source(spark, src).orderBy("ord").collect()]
    mixed = [r.text for r in readers.read_source(spark, src, CleanRules(), 7, 50).orderBy("ord").collect()]
    assert plain[0].startswith("document number 0 ") and sorted(plain) == sorted(mixed) and plain != mixed


def test_prepare_corpus(spark, shards, tmp_path):
    src = [readers.Source("s", path=f"{shards}/in_*.jsonl")]
    out = f"{tmp_path}/out"
    done = {s: prepare_corpus(spark, src, f"{out}/{s}", CorpusSpec(split=s, holdout_mod=10, per_shard=100, seed=k, shuffle_buffer=20)) for k, s in enumerate(("train", "val"))}
    texts = {s: [json.loads(x)["text"] for p in sorted((tmp_path / "out" / s).glob("shard_*.jsonl")) for x in p.read_text().splitlines()] for s in done}
    assert not set(texts["train"]) & set(texts["val"]) and len(texts["train"]) + len(texts["val"]) == 500
    m = json.loads((tmp_path / "out/train/manifest.json").read_text())
    assert m == done["train"] and m["document_count"] == len(texts["train"]) and m["holdout"]["holdout_mod"] == 10
    for s in m["shards"]:
        assert hashlib.sha256((tmp_path / "out/train" / s["path"]).read_bytes()).hexdigest() == s["sha256"]
    with pytest.raises(ValueError):
        prepare_corpus(spark, src, f"{out}/x", CorpusSpec(max_tokens=5))


def test_shards_end_empty_when_full(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("k"), F.concat(F.lit("é"), "id").alias("text"))
    files = write_shards(df, f"file://{tmp_path}/w", ["k"], per_shard=10)
    assert [f.rsplit("/", 1)[1] for f in files] == ["shard_00000.jsonl", "shard_00001.jsonl", "shard_00002.jsonl"]
    assert (tmp_path / "w/shard_00001.jsonl").read_text().splitlines()[0] == '{"text":"é10"}'
    assert (tmp_path / "w/shard_00002.jsonl").read_text() == ""
    assert len(write_shards(df.limit(0), f"file://{tmp_path}/e", ["k"])) == 1


def test_shards_are_committed_by_tasks(spark, tmp_path):
    """Digests come with the shards, a second run replaces them, and a rename that was done is done."""
    df = spark.range(95).select(F.floor(F.col("id") / 2).alias("k"), F.concat(F.lit("line\u2028 "), "id").alias("text"), F.lit(1).alias("shard"))
    for _ in range(2):
        done = commit_shards(df.drop("shard"), f"{tmp_path}/w", ["k"], per_shard=10).collect()
        assert sorted((r.shard, r.docs) for r in done) == [(k, 10 if k < 9 else 5) for k in range(10)]
        for r in done:
            body = (tmp_path / f"w/shard_{r.shard:05d}.jsonl").read_bytes()
            assert (len(body), hashlib.sha256(body).hexdigest()) == (r.bytes, r.sha256)
        assert sorted(p.name for p in (tmp_path / "w").iterdir()) == [f"shard_{k:05d}.jsonl" for k in range(10)]
    texts = [json.loads(x)["text"] for k in range(10) for x in (tmp_path / f"w/shard_{k:05d}.jsonl").read_text().split("\n") if x]
    assert len(set(texts)) == 95 and [int(t.split()[-1]) // 2 for t in texts] == sorted(k // 2 for k in range(95))
    (tmp_path / "a").write_text("x")
    for _ in range(2):
        move_once(f"file:{tmp_path}/a", f"file:{tmp_path}/b")
    assert (tmp_path / "b").read_text() == "x"
    with pytest.raises(OSError):
        move_once(f"file:{tmp_path}/none", f"file:{tmp_path}/nowhere")


def test_small_files_are_replaced_whole(spark, tmp_path):
    for text in ("one", "two é"):
        write_text(spark, f"{tmp_path}/x.json", text)
        assert read_text(spark, f"{tmp_path}/x.json") == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["x.json"]


def test_rotation(spark):
    names = spark.createDataFrame([(f"s{k}",) for k in range(5)], "name string")
    assert sorted(r.name for r in keep_newest(names, 2).collect()) == ["s0", "s1", "s2"]
    assert keep_newest(names, 0).count() == 0


def test_bpe(spark):
    lines = ["the quick brown fox", "안녕하세요 반갑습니다", "jumps over the lazy dog", "click here <|eos|> and then <|assistant|> replies"] * 50
    docs = spark.createDataFrame([(t,) for t in lines], "text string")
    spec = tokenizer.train_bpe(docs, 320, 1)
    tokenizer.require_vocab(spec, 320)
    with pytest.raises(ValueError):
        tokenizer.require_vocab(spec, 300)
    assert tokenizer.round_trip(docs, spec).where("not exact").count() == 0
    special = {r.token: r.id for r in tokenizer.vocabulary(spark, spec).collect()}
    ids = docs.where("text like 'click%'").select(tokenizer.encode(F.col("text"), spec).alias("p"), tokenizer.encode(F.col("text"), spec, True).alias("s")).first()
    assert special["<|eos|>"] not in ids.p and special["<|eos|>"] in ids.s
    assert len(tokenizer.special_tokens()) == 23 and tokenizer.merges(spark, spec).count() > 0
    assert special["t"] in tokenizer.single_character_tokens(spec)


def test_bpe_trains_on_every_occurrence(spark):
    """As the library's trainer on all texts: with counts above 1000 that differ, and pairs only of pieces seen once."""
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    lines = ["abab"] * 1500 + ["cdcdcd"] * 4000 + ["aaaaa efef"] * 1200 + ["efgh ijk"] * 2500 + [f"{c}qzx" for c in "lmnop"]
    lib = Tokenizer(models.BPE(byte_fallback=True))
    lib.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    lib.train_from_iterator(lines, trainers.BpeTrainer(vocab_size=400, min_frequency=2, special_tokens=tokenizer.special_tokens(), initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    spec = tokenizer.train_bpe(spark.createDataFrame([(t,) for t in lines], "text string"), lib.get_vocab_size(), 2)
    assert json.loads(spec)["model"] == json.loads(lib.to_str())["model"]
    assert ["qz", "x"] in json.loads(spec)["model"]["merges"]


@pytest.mark.parametrize("letters,longest,entries,held", [("ab", 14, 60, 20), ("abc", 9, 200, 60), ("abcdefgh", 6, 150, 40)])
def test_bpe_in_rounds_equals_the_library(spark, letters, longest, entries, held):
    """Few letters make merges that overlap, tie, and write one string in two ways; runs held are far fewer than pieces."""
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    r = random.Random(longest)
    lines = ["".join(r.choices(letters, k=r.randint(1, longest))) + " a\u00e9aaaaa"[: r.randint(0, 8)] for _ in range(1500)] + ["a" * 3000, "", " "]
    lib = Tokenizer(models.BPE(byte_fallback=True))
    lib.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    lib.train_from_iterator(lines, trainers.BpeTrainer(vocab_size=256 + entries, min_frequency=2, special_tokens=[], initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    want = json.loads(lib.to_str())["model"]
    counts = tokenizer.piece_counts(spark.createDataFrame([(t,) for t in lines], "text string").repartition(3))
    ids, merges = bpe.learn_merges(counts, len(want["vocab"]), 2, held)
    assert ids == want["vocab"] and [list(m) for m in merges] == want["merges"]


def test_bpe_of_little(spark):
    few = spark.createDataFrame([("ab", 5), ("b", 9)], "piece string, n long")
    for held in (1, 100):
        ids, merges = bpe.learn_merges(few, 300, 1, held)
        assert merges == [("a", "b")] and ids["ab"] == 256 and len(ids) == 257
        assert bpe.learn_merges(few, 300, 6, held)[1] == [] and bpe.learn_merges(few.limit(0), 300, 1, held)[1] == []


def test_merges_in_a_block():
    """One block after several merges, and the changes of its pairs, against word by word."""
    r = random.Random(1)
    words = [[r.randrange(3) for _ in range(r.randint(2, 12))] for _ in range(200)]
    n = [r.randint(1, 9) for _ in words]
    block = bpe.Block(np.array([s for w in words for s in w], dtype=np.int32), np.array([len(w) for w in words], dtype=np.int32), np.array(n))
    plan = [("\0\0", 3), ("\1\2", 4), ("\3\4", 5), ("\2\0", 6)]
    code = np.array([ord(p[0]) << 32 | ord(p[1]) for p, _ in plan])
    order = np.argsort(code)
    after, codes, sums, up = bpe.apply(block, code[order], order, np.array([s for _, s in plan])[order])
    changed, came, left = Counter(), set(), Counter()
    for w, k in zip(words, n):
        word = "".join(map(chr, w))
        for pair, new in plan:
            word, changes = bpe._merged(word, pair, chr(new))
            for p, c in changes:
                changed[p] += c * k
                came |= {p} if c > 0 else set()
        left[word] += k if len(word) > 1 else 0
    ends = np.cumsum(after.sizes)
    got = Counter()
    for stop, size, k in zip(ends, after.sizes, after.n):
        got["".join(map(chr, after.symbols[stop - size : stop]))] += int(k)
    assert got == +left
    pair = lambda c: chr(int(c) >> 32) + chr(int(c) & 0xFFFFFFFF)
    assert {pair(c): int(x) for c, x in zip(codes, sums)} == dict(changed) and {pair(c) for c, u in zip(codes, up) if u} == came


def test_pre_tokens_match_the_library(spark):
    from tokenizers import pre_tokenizers

    lib = pre_tokenizers.ByteLevel(add_prefix_space=False)
    texts = ["It's  a test,\n\n really 123!", "안녕 하세요 42", "  x\t y'll've", "été½²"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokenizer.pre_tokens(F.col("t")).alias("p")).collect()
    for r in got:
        assert r.p == [r.t[a:b] for _, (a, b) in lib.pre_tokenize_str(r.t)]


def test_config(tmp_path):
    c = RunConfig.from_dict({"project": {"run_name": "r"}, "optimizer": {"learning_rate": "6e-4"}, "model": {"n_head": 8, "n_kv_head": 2, "d_model": 512, "activation": "gelu"}, "data": {"sources": [{"name": "a", "weight": "0.7"}], "mixture_weighting": "document"}, "training": {"micro_batch_size": "4"}})
    assert c.optimizer.learning_rate == 6e-4 and c.data.sources[0].weight == 0.7 and c.training.micro_batch_size == 4
    assert (c.model.head_dim, c.model.d_ff, RunConfig.from_dict({}).model.d_ff) == (64, 2048, 2048)
    assert RunConfig.from_dict(c.to_dict()) == c
    c.save(f"{tmp_path}/run.json")
    assert RunConfig.from_dict(json.loads((tmp_path / "run.json").read_text())) == c
    (tmp_path / "run.yaml").write_text("project:\n  run_name: y\nmodel:\n  rope_theta: 1e5\nevaluation:\n  downstream_tasks:\n  - {name: t, path: p, language: ko}\n")
    y = RunConfig.from_yaml(f"{tmp_path}/run.yaml")
    assert y.model.rope_theta == 1e5 and y.evaluation.downstream_tasks[0].during_training
    bad = [
        {"nope": 1}, {"model": {"n_kv_heads": 2}}, {"data": {"mixture_weighting": "words"}}, {"training": {"micro_batch_size": "2.5"}}, {"training": {"precision": "float16"}}, {"model": {"norm": "x"}},
        {"model": {"positional_encoding": "x"}}, {"model": {"activation": "x"}}, {"optimizer": {"name": "sgd"}}, {"scheduler": {"name": "linear"}}, {"logging": {"backend": "wanb"}},
        {"evaluation": {"downstream_tasks": [{"name": "t", "path": "p", "language": "fr"}]}}, {"data": {"sources": [{"weight": 1}]}}, {"model": {"n_head": 7}}, {"model": {"n_kv_head": 5}}, {"checkpoint": {"save_best": "yes"}},
    ]
    for values in bad:
        with pytest.raises(ValueError):
            RunConfig.from_dict(values)
    assert may_resume({"world": 8, "micro_batch_size": 4}, c, 4) == ["world"]


def test_recipes(tmp_path):
    parts = recipe("pretraining", seed=1)
    limits = {k: (s[0].name, spec.split, spec.max_tokens, spec.seed) for k, (s, spec) in parts.items()}
    assert limits["train_en"][2:] == (10_925_000_000, 1) and limits["val_en"][1:] == ("val", 20_000_000, 8) and limits["val_ko"][2] == 10_000_000
    assert {k: spec.max_tokens for k, (_, spec) in recipe("continued").items()} == {"train_en": 600_000_000, "val_en": 5_000_000, "train_ko": 1_400_000_000, "val_ko": 10_000_000}
    assert recipe("architecture")["val_en"][1].seed == 43
    sources, spec = tokenizer_recipe()
    assert [s.weight for s in sources] == [0.75, 0.25] and (spec.split, spec.max_bytes) == ("all", 20_000_000_000)
    (tmp_path / "t.yaml").write_text("vocab_size: 300\nmin_frequency: 1\nseed: 7\ndata:\n  english: {name: e, weight: 0.6, target_gb: 1.5}\n  korean: {name: k, subset: s, weight: 0.4, target_gb: 0.5}\n")
    sources, spec = tokenizer_recipe(f"{tmp_path}/t.yaml")
    assert [(s.name, s.subset) for s in sources] == [("e", None), ("k", "s")] and spec.max_bytes == 2_000_000_000
    c = TokenizerConfig.from_yaml(f"{tmp_path}/t.yaml", ["a.txt"])
    assert (c.vocab_size, c.seed, c.input_files) == (300, 7, ["a.txt"])
    (tmp_path / "u.yaml").write_text("vocab: 300\n")
    with pytest.raises(ValueError):
        TokenizerConfig.from_yaml(f"{tmp_path}/u.yaml")
    with pytest.raises(ValueError):
        tokenizer_recipe(f"{tmp_path}/u.yaml")


def test_recipe_is_cut_by_language(spark, shards, tmp_path):
    spec = tokenizer.train_bpe(readers.read_jsonl(spark, f"{shards}/in_*.jsonl"), 400, 1)
    parts = recipe("architecture", tokenizer=spec, tokens=2000, val_tokens=60, paths={"en": f"{shards}/in_*.jsonl", "ko": f"{shards}/in_0.jsonl"})
    done = prepare_recipe(spark, {k: parts[k] for k in ("train_en", "train_ko", "val_ko")}, f"{tmp_path}/out")
    assert 1900 <= done["train_en"]["token_count"] < 1950 and 100 <= done["train_ko"]["token_count"] < 150 and done["val_ko"]["holdout"]["role"] == "val"


def test_mirror_and_file_order(spark, shards, tmp_path):
    folder = tmp_path / "mirror/org/set/main/ko/train"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text('{"text": "from the mirror"}\n')
    spark.conf.set(readers.MIRROR, str(tmp_path / "mirror"))
    try:
        assert [r.text for r in readers.read_source(spark, readers.Source("org/set", subset="ko")).collect()] == ["from the mirror"]
    finally:
        spark.conf.unset(readers.MIRROR)
    src = [readers.Source("s", path=f"{shards}/in_*.jsonl")]
    got = [int(r.text.split()[2]) for r in readers.read_sources(spark, src, seed=5, buffer_size=40, shuffle="buffer").orderBy("ord").collect()]
    files = ordering.shuffled_files([f"in_{k}.jsonl" for k in range(4)], 5)
    plain = [int(f[3]) * 125 + i for f in files for i in range(125)]
    assert got == [plain[k] for k in ordering.buffered_order(500, 6, 40)]
    with pytest.raises(ValueError):
        readers.read_source(spark, src[0], shuffle="none")


def test_blank_lines_are_unicode_blank(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\n\t\t\n\u2003\nb\n", encoding="utf-8")
    assert sorted(r.text for r in readers.read_plain_lines(spark, f"{tmp_path}/x.txt").collect()) == ["a", "b"]


def test_tokenizer_files_and_evaluation(spark, tmp_path):
    from tokenizers import Tokenizer

    (tmp_path / "in.txt").write_text("\n".join(["the quick brown fox", "안녕하세요 반갑습니다 abc"] * 30), encoding="utf-8")
    config = TokenizerConfig([f"{tmp_path}/in.txt"], vocab_size=320, min_frequency=1, output_dir=f"{tmp_path}/tok")
    spec = tokenizer.train_from_config(spark, config)
    assert sorted(x.name for x in (tmp_path / "tok").iterdir() if not x.name.startswith(".")) == ["merges.txt", "special_tokens_map.json", "tokenizer.json", "tokenizer_config.json", "training_config.json", "vocab.json"]
    back = Tokenizer.from_file(f"{tmp_path}/tok/tokenizer.json")
    assert [back.id_to_token(k) for k in range(23)] == tokenizer.special_tokens()
    vocab = json.loads((tmp_path / "tok/vocab.json").read_text())
    assert len(vocab) == 320 and vocab["<|bos|>"] == 0 and json.loads((tmp_path / "tok/training_config.json").read_text())["seed"] == 42
    with pytest.raises(ValueError):
        tokenizer.save_tokenizer(spark, spec, f"{tmp_path}/bad", TokenizerConfig(vocab_size=321))
    docs = spark.createDataFrame([("the quick fox",), ("안녕 q",), (None,), ("",)], "text string")
    result = tokenizer.evaluate_tokenizer(spark, spec, {"english": docs}, output=f"{tmp_path}/eval.json")
    ids = [back.encode(t, add_special_tokens=False).ids for t in ("the quick fox", "안녕 q")]
    single = sum(len(back.decode([i])) == 1 for x in ids for i in x)
    assert json.loads((tmp_path / "eval.json").read_text()) == result
    assert result["english"]["tokens"] == sum(map(len, ids)) and result["english"]["documents"] == 4
    assert result["english"]["single_char_token_fraction"] == pytest.approx(single / sum(map(len, ids)))
    assert all(result["special_tokens_single_id"].values()) and all(q["roundtrip_ok"] for q in result["qualitative"])


def feed(spark, folder, k):
    spark.createDataFrame([(k * 10 + i, f"some text that is long enough {i}", f"s{i % 2}", [k * 10 + i] * 7) for i in range(10)], "ord long, text string, source string, tokens array<int>").coalesce(1).write.mode("append").parquet(folder)


FED = "ord long, text string, source string, tokens array<int>"


def test_streams_go_on_after_a_restart(spark, tmp_path):
    from millrace.streaming.corpus import BlockStream, ShuffleStream, arriving, clean_split_stream, read_statistics, source_statistics_stream

    source = f"{tmp_path}/in"
    want = 0
    for start in range(2):  # each turn brings files, then a stream that is started anew
        for k in range(start * 2, start * 2 + 2):
            feed(spark, source, k)
            want += 10
        rows = lambda: arriving(spark, source, FED)
        clean_split_stream(rows(), f"{tmp_path}/clean", split="all").awaitTermination()
        assert sorted(r.ord for r in spark.read.parquet(f"{tmp_path}/clean").collect()) == list(range(want))
        source_statistics_stream(rows(), f"{tmp_path}/stats").awaitTermination()
        assert {r.source: r.docs for r in read_statistics(spark, f"{tmp_path}/stats").collect()} == {"s0": want // 2, "s1": want // 2}
        ShuffleStream(rows(), f"{tmp_path}/mixed", 3, "ord").wait()
        mixed = spark.read.parquet(f"{tmp_path}/mixed").collect()
        assert sorted(r.ord for r in mixed) == list(range(want))
        blocks = BlockStream(rows(), f"{tmp_path}/blocks", 16, "ord")
        blocks.wait()
        got = blocks.blocks().orderBy("block_id").collect()
        stream = [x for k in range(want) for x in [k] * 7]
        assert [r.block_id for r in got] == list(range(len(stream) // 16))
        assert [list(r.tokens) for r in got] == [stream[k * 16 : k * 16 + 16] for k in range(len(stream) // 16)]
    first = [r.ord for r in mixed if r.batch == 0]
    assert len(first) == 10 and first != sorted(first)


def test_a_stream_budget_outlives_restarts(spark, tmp_path):
    from millrace.streaming.corpus import BudgetStream, arriving

    source, out = f"{tmp_path}/in", f"{tmp_path}/cut"
    one = len("some text that is long enough 0")
    for k in range(2):
        feed(spark, source, k)
    BudgetStream(arriving(spark, source, FED), out, 25 * one, "ord").wait()
    assert sorted(r.ord for r in spark.read.parquet(out).collect()) == list(range(20))
    for k in range(2, 5):
        feed(spark, source, k)
    for _ in range(2):  # the budget is reached in the third file; a further start adds nothing
        BudgetStream(arriving(spark, source, FED), out, 25 * one, "ord").wait()
        assert sorted(r.ord for r in spark.read.parquet(out).collect()) == list(range(25))
    BudgetStream(arriving(spark, source, FED), out, 27 * one, "ord").wait()  # a little more: it ends in the same file
    assert sorted(r.ord for r in spark.read.parquet(out).collect()) == list(range(27))
    for _ in range(2):  # more: neither the rest of that file nor later files were lost
        BudgetStream(arriving(spark, source, FED), out, 45 * one, "ord").wait()
        assert sorted(r.ord for r in spark.read.parquet(out).collect()) == list(range(45))


@pytest.mark.parametrize("seed", [1, 2])
def test_a_mixture_of_arriving_documents_is_that_of_the_table(spark, tmp_path, seed):
    """Any parts, any number of restarts, documents without length, a source that comes late, one without weight."""
    from millrace.operators import mixture
    from millrace.streaming.corpus import MixtureStream, arriving

    r = random.Random(seed)
    weights = {"a": 3.0, "b": 1.0, "c": 0.7}
    rows = [(k, r.choice("aab") if k < 60 else r.choice("abcx"), "t" * r.choice([0, 1, 1, 5, 40])) for k in range(150)]
    schema = "doc long, source string, text string"
    cuts = sorted(r.sample(range(1, 150), 4))
    stream = None
    for k, (i, j) in enumerate(zip([0, *cuts], [*cuts, 150])):
        spark.createDataFrame(rows[i:j], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k:03d}")
        if k % 2 or j == 150:
            stream = MixtureStream(arriving(spark, f"{tmp_path}/in/*", schema), f"{tmp_path}/out", weights, "source", "doc")
            stream.wait()
    out = lambda: {x.doc: x.pos for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {x.doc: x.pos for x in mixture.stride(mixture.with_length(spark.createDataFrame(rows, schema)), weights, "source", "doc").collect()}
    early = out()
    assert early and early.items() <= want.items()
    stream.finish()
    stream.finish()
    assert out() == want


def test_pieces_are_encoded_once_and_as_the_library_does(spark):
    r = random.Random(12)
    docs = spark.createDataFrame([("don't stop, the 12 words  of\n\na text " * 3,)], "text string")
    spec = tokenizer.train_bpe(docs, 300, 1)
    texts = ["".join(r.choice("ab'sdtrevlm 0²½\n\t\r\x1c\x1f\x85\xa0\xad×Àɏɐßé.!<|>\x00") for _ in range(r.randrange(40))) for _ in range(400)]
    texts += [*tokenizer.special_tokens(), "<|bos|>a <|eos|>", "", "  a  ", "''s 's", "漢字 x", *[f" {chr(c)}a" for c in range(0x250)]]
    own = tokenizer.PieceIds(spec)
    assert own.packed(texts) == own.by_library(texts)
    got = {x.text: x.ids for x in spark.createDataFrame([(x,) for x in texts], "text string").select("text", tokenizer.encode(F.col("text"), spec).alias("ids")).collect()}
    assert got == {t: np.frombuffer(x, "<i4").tolist() for t, x in zip(texts, own.by_library(texts))}
    own, asked = tokenizer.PieceIds(spec), []
    library = own.by_library
    own.by_library = lambda t: asked.extend(t) or library(t)
    for _ in range(3):
        own.packed(["one two one two", "two one two"] * 4)
    assert sorted(asked) == [" one", " two", "one", "two"]

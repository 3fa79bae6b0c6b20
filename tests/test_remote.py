"""A set served over HTTP, read as a batch and as a stream."""

import functools
import http.server
import json
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace.sources import readers, remote


class Ranges(http.server.SimpleHTTPRequestHandler):
    """Files by range; now and then the server is busy."""

    log: list = []
    calls = 0

    def log_message(self, *args):
        pass

    def do_GET(self):
        Ranges.calls += 1
        if Ranges.calls % 7 == 3:
            return self.send_error(503)
        wanted = self.headers.get("Range")
        if not wanted:
            return super().do_GET()
        with open(self.translate_path(self.path), "rb") as f:
            body = f.read()
        first, last = map(int, wanted.removeprefix("bytes=").split("-"))
        part = body[first : last + 1]
        Ranges.log.append((self.path, len(part)))
        self.send_response(206)
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)


@pytest.fixture()
def served(tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Ranges, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Ranges.log.clear()
    yield tmp_path, f"http://127.0.0.1:{server.server_port}/{{name}}/{{revision}}.json"
    server.shutdown()


def write_set(root, files, extra=()):
    folder = root / "org/set"
    folder.mkdir(parents=True, exist_ok=True)
    listed = []
    for name, texts in files.items():
        if name.endswith(".parquet"):
            noise = ["n" * 2000 + f"{i}{name}" * 50 for i in range(len(texts))]
            pq.write_table(pa.table({"text": texts, "noise": noise}), folder / name, row_group_size=20, use_dictionary=False, compression="none")
        else:
            (folder / name).write_text("\n".join(texts) + "\n")
        listed.append({"url": name, "filename": name, "size": (folder / name).stat().st_size, "split": "train", "config": "default"})
    (folder / "main.json").write_text(json.dumps({"parquet_files": [*listed, *extra]}))


def test_batch_reads_each_row_once(spark, served, monkeypatch):
    root, listing = served
    files = {f"f{k}.parquet": [f"text {k} {i}" if i % 9 else None for i in range(150)] for k in range(3)}
    write_set(root, files, [{"url": "other.parquet", "filename": "other.parquet", "size": 5, "split": "test", "config": "default"}])
    remote.register(spark)
    df = spark.read.format("remote_set").options(listing=listing, name="org/set", split="train", part_bytes=40_000).load()
    want = sorted((name, i, t) for name, texts in files.items() for i, t in enumerate(texts) if t)
    assert sorted(map(tuple, df.collect())) == want
    assert df.rdd.getNumPartitions() >= 9
    missing = spark.read.format("remote_set").options(listing=listing, name="org/set", split="none").load()
    with pytest.raises(Exception, match="lists no file"):
        missing.count()


def test_only_the_column_is_fetched(served, monkeypatch):
    root, listing = served
    monkeypatch.setattr(remote, "AHEAD", 4096)
    write_set(root, {"f.parquet": [f"text {i}" for i in range(400)]})
    (file,) = remote.listed_files({"listing": listing, "name": "org/set"})
    rows = [r for b in remote.read_part(remote.Part(file, 0, 1), "text") for r in b.to_pylist()]
    assert [r["text"] for r in rows] == [f"text {i}" for i in range(400)] and sum(n for _, n in Ranges.log) < file.size / 4


def test_json_lines_and_servers_without_ranges(served, monkeypatch):
    root, listing = served
    lines = [json.dumps({"text": "one"}), "no json", '{"text": ""}', '["x"]', r'{"text": "half \ud800"}', json.dumps({"text": "zweiä", "more": 1}), '{"text": 5}']
    write_set(root, {"a.jsonl": lines, "b.parquet": ["p", "q"]})
    monkeypatch.setattr(Ranges, "do_GET", http.server.SimpleHTTPRequestHandler.do_GET)
    found = [tuple(r.values()) for f in remote.listed_files({"listing": listing, "name": "org/set"}) for b in remote.read_part(remote.Part(f, 0, 1), "text") for r in b.to_pylist()]
    assert found == [("a.jsonl", 0, "one"), ("a.jsonl", 5, "zweiä"), ("b.parquet", 0, "p"), ("b.parquet", 1, "q")]


def test_restarted_stream_reads_each_file_once(spark, served):
    root, listing = served
    files = {f"f{k}.parquet": [f"text {k} {i}" for i in range(30)] for k in range(3)}
    write_set(root, files)
    remote.register(spark)

    def run():
        rows = spark.readStream.format("remote_set").options(listing=listing, name="org/set", files_per_trigger=2).load()
        rows.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.text for r in spark.read.parquet(f"{root}/out").collect())

    def until(n):
        for _ in range(4):  # two files a run
            got = run()
            if len(got) >= n:
                return got
        return got

    assert until(90) == sorted(t for texts in files.values() for t in texts)
    files["f9.parquet"] = ["late one", "late two"]
    write_set(root, files)
    assert until(92) == sorted(t for texts in files.values() for t in texts)
    write_set(root, {"f7.parquet": ["other"], **files})
    with pytest.raises(Exception, match="no longer lists"):
        run()


def test_source_without_a_path_is_read_from_the_listing(spark, served):
    root, listing = served
    write_set(root, {f"f{k}.parquet": [f"long enough text {k} {i}" for i in range(40)] for k in range(2)})
    spark.conf.set(readers.LISTING, listing)
    try:
        source = readers.Source("org/set")
        plain = readers.read_source(spark, source).orderBy("ord").collect()
        assert [r.text for r in plain] == [f"long enough text {k} {i}" for k in range(2) for i in range(40)]
        mixed = [r.text for r in readers.read_source(spark, source, shuffle_seed=3, shuffle_buffer=10).orderBy("ord").collect()]
        assert sorted(mixed) == sorted(r.text for r in plain) and mixed != [r.text for r in plain]
        buffered = [r.text for r in readers.read_source(spark, source, shuffle_seed=3, shuffle_buffer=10, shuffle="buffer").orderBy("ord").collect()]
        assert sorted(buffered) == sorted(mixed) and buffered != mixed
    finally:
        spark.conf.unset(readers.LISTING)

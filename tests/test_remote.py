import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from vellumkit import config
from vellumkit.operators import benchmarks as B, curation as C, messages as S, metrics as M, model, remote
from vellumkit.functions import text as X
from vellumkit.sources import fetch

from .test_sources import PNG


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        seen: list = []
        failed: set = set()

        def log_message(self, *a):
            pass

        def send(self, body, code=200):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            if self.path == "/v1/models":
                self.send(b'{"data": [{"id": "tiny"}]}')
            elif self.path == "/once" and "once" not in self.failed:
                self.failed.add("once")
                self.send(b"", 503)
            else:
                self.send(PNG if self.path in ("/a.png", "/once") else b"", 200 if self.path in ("/a.png", "/once") else 404)

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.seen.append(body)
            text = body["messages"][-1]["content"][-1]["text"]
            if text == "fail":
                self.send(b"no", 500)
            else:
                self.send(json.dumps({"choices": [{"message": {"content": f"{body['model']} {text} {len(body['messages'][-1]['content'])}"}}]}).encode())

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", Handler
    s.shutdown()


def test_media_are_fetched(spark, server, tmp_path):
    (tmp_path / "f.png").write_bytes(PNG)
    url = server[0]
    urls = [f"{url}/a.png", f"{url}/once", f"{url}/missing", f"file://{tmp_path}/f.png", str(tmp_path / "f.png"), str(tmp_path / "none"), "data:image/png;base64," + base64.b64encode(PNG).decode(), None]
    got = [r["f"] for r in spark.createDataFrame([(u,) for u in urls], "u string").coalesce(1).select(fetch.fetched(F.col("u")).alias("f")).collect()]
    assert [f["content"] is not None and bytes(f["content"]) == PNG for f in got] == [True, True, False, True, True, False, True, False]
    assert "404" in got[2]["error"] and "FileNotFound" in got[5]["error"] and got[7]["error"] is None
    kinds = "idx long, message array<struct<role: string, content: array<struct<type: string, text: string, media: string>>>>"
    rows = [(1, [("user", [("image", None, str(tmp_path / "f.png")), ("text", "x", None), ("video", None, "v.mp4")])]), (2, [("user", [("text", "x", None)])])]
    out = {r["idx"]: r for r in fetch.vision_batch(spark.createDataFrame(rows, kinds), "idx").collect()}
    assert [(s["height"], s["width"]) for s in out[1]["sizes"]] == [(5, 7)] and out[1]["videos"][0]["media"] == "v.mp4" and out[1]["video_kwargs"]["fps"] == [2.0]
    assert out[2]["images"] == [] and out[2]["video_kwargs"]["fps"] == []


def test_http_model(spark, server, tmp_path):
    (tmp_path / "f.png").write_bytes(PNG)
    df = spark.createDataFrame([(1, "hello", None), (2, "fail", None), (3, "see", f"file://{tmp_path}/f.png"), (4, None, None)], "id int, prompt string, image string")
    got = {r["id"]: r["output"] for r in model.infer(df, remote.http_model(server[0] + "/v1/", image="image", system="be brief", max_tokens=5)).collect()}
    assert got == {1: "tiny hello 1", 2: None, 3: "tiny see 2", 4: "tiny  1"}
    body = next(b for b in server[1].seen if b["messages"][-1]["content"][-1]["text"] == "see")
    assert body["max_tokens"] == 5 and body["temperature"] == 0 and "top_p" not in body and body["messages"][0]["role"] == "system"
    assert body["messages"][1]["content"][0]["image_url"]["url"] == "data:image;base64," + base64.b64encode(PNG).decode()
    nested = [{"a": [{"type": "image", "image": "data:image/png;base64,xx", "min_pixels": 3}], "text": "http://not.fetched"}]
    assert remote.with_inline_images(nested, {"d": 1}) == [{"a": [{"type": "image_url", "min_pixels": 3, "image_url": {"url": "data:image/png;base64,xx"}, "d": 1}], "text": "http://not.fetched"}]


def test_settings():
    c, rest = config.parse(config.EvalConfig, ["--benchmarks", "a", "b_4", "--batch-size", "8", "--force", "--top_p", "0.5", "--greedy", "--name=x y", "--none-of", "none"])
    assert (c.benchmarks, c.batch_size, c.force, c.prompt_type) == (["a", "b_4"], 8, True, "json")
    assert rest == {"top_p": 0.5, "greedy": True, "name": "x y", "none_of": None}
    assert config.parse(config.DataConfig, [])[0].max_packed_length == -100 and config.parse(config.DataConfig, ["--max-pixels", "9"])[0].max_pixels == 9
    with pytest.raises(ValueError):
        config.parse(config.DataConfig, ["--odd", "1", "2"])


def test_small_rules(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0]), (3, None), (4, [1.0, None, 3.0, 4.0])], "id int, box array<double>")
    assert [r["id"] for r in C.drop_malformed(rows, "box").collect()] == [1]
    cat = spark.createDataFrame([("b", "p", "det"), ("a", "q", "det"), ("c", "r", "sft")], "name string, annotation_path string, dataset_type string")
    assert {r["dataset_type"]: [c["name"] for c in r["configs"]] for r in C.configs_by_type(cat).collect()} == {"det": ["a", "b"], "sft": ["c"]}
    ranked = spark.createDataFrame([("Answer in JSON",), (None,)], "instruction string")
    B.check_prompt_type(ranked, "json")
    with pytest.raises(ValueError):
        B.check_prompt_type(ranked, "plain")


def lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_likeness_of_labels(spark):
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(0, 9))) for _ in range(2))
        want = 200 * lcs(a, b) / (len(a) + len(b)) if a and b else 100.0 * (a == b)
        assert X.indel_ratio(a, b) == pytest.approx(want) and X.weighted_ratio(a, b) == pytest.approx(X.weighted_ratio(b, a))
    assert X.weighted_ratio("large vehicle", "vehicle large") == pytest.approx(95) and X.weighted_ratio("ship", "ship") == 100
    assert X.partial_ratio("field", "ground track field") == 100 and X.weighted_ratio("field", "ground track field") == pytest.approx(90)
    assert X.weighted_ratio("", "x") == 0 and X.indel_ratio("this is a test", "this is a test!") == pytest.approx(96.551724, abs=1e-5)
    df = spark.createDataFrame([(1, "ship"), (2, "vehicle large"), (3, "soccer field"), (4, None), (5, ""), (6, "vehicle large")], "id int, label string")
    got = {r["id"]: r["matched"] for r in S.weighted_labels(df, "label", ["plane", "large vehicle", "ship", "soccer ball field"]).collect()}
    assert got == {1: "ship", 2: "large vehicle", 3: "soccer ball field", 4: None, 5: None, 6: "large vehicle"}


def test_treebank_words(spark):
    texts = ["It's a dog-house, isn't it?", 'He said: "No... 3.5 km!" (twice)', "the boys' ball -- red", None, ""]
    got = [r["t"] for r in spark.createDataFrame([(x,) for x in texts], "x string").coalesce(1).select(X.ptb_tokens(F.col("x")).alias("t")).collect()]
    assert got == [["it", "'s", "a", "dog-house", "is", "n't", "it"], ["he", "said", "no", "3.5", "km", "twice"], ["the", "boys", "ball", "red"], None, []]
    df = spark.createDataFrame([(1, "the red dog ran off.", ["The red dog, ran off!"])], "k int, p string, refs array<string>")
    assert M.bleu4(df, "k", "p", "refs", X.ptb_tokens).first()["bleu4"] == pytest.approx(1.0) and M.bleu4(df, "k", "p", "refs").first()["bleu4"] < 1

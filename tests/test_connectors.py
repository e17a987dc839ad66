import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from tokenloom import backends, prompt_loop, sources, streaming
from tokenloom.backends import Http, Local, Options, Replay
from tokenloom.engine import Engine, finish
from tokenloom.operators import codec, corpus, evaluate, sequence
from tokenloom.schema import PATTERN, TOKENS, TREE_PATTERN  # noqa: F401
from pyspark.sql import functions as F

GOOD = "1\tI\t_\tPRON\tI\tnsubj\t2\n2\tam\tnone\tAUX\tbe\troot\t0\n\n</analysis>"


@pytest.fixture
def server():
    asked = []

    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body))
            what = body["messages"][0]["content"]
            kinds = {"none": '{"choices": []}', "broken": "{not json", "odd": '{"choices": [{}]}', "list": "[]"}
            status = 400 if "bad" in what else 503 if "down" in what else 200
            text = next((v for k, v in kinds.items() if f"Sentence: {k}" in what), json.dumps({"choices": [{"message": {"content": GOOD}}]}))
            self.send_response(status)
            cut = "short" in what
            self.send_header("Content-Length", str(len(text) + 50 * cut))
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *a):
            pass

    it = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=it.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{it.server_port}/", asked
    it.shutdown()


def test_http(spark, server):
    url, asked = server
    texts = ["I am", "none", "broken", "odd", "list", "bad", "down", "short"]
    engine = Engine(Http(url, Options(retries=1, top_p=0.5, timeout_s=20)))
    got = {r.sentence: r for r in engine.analyze(sources.from_sentences(spark, texts)).collect()}
    assert (got["I am"].error, [t.lemma for t in got["I am"].tokens], got["I am"].repair) == (None, ["I", "be"], "exact")
    assert got["none"].response == "" and got["none"].error.startswith("Reconstructed text")
    assert tuple(got["none"].error_detail) == ("", "none", "")
    for k in ("broken", "odd", "list"):
        assert got[k].error.startswith("Failed to parse response") and got[k].response is None
    assert got["bad"].error.startswith("Remote endpoint returned error 400") and got["down"].error.startswith("Remote endpoint returned error 503")
    assert "IncompleteRead" in got["short"].error
    path, body = asked[0]
    assert path == "/v1/chat/completions" and (body["max_tokens"], body["temperature"], body["top_p"]) == (512, 0.1, 0.5)
    assert sum("down" in b["messages"][0]["content"] for _, b in asked) == 2 and sum("bad" in b["messages"][0]["content"] for _, b in asked) == 1


def test_no_server(spark):
    row = Engine(Http("http://127.0.0.1:9", Options(retries=0, connect_s=2))).analyze(sources.from_sentences(spark, ["x"])).first()
    assert "refused" in row.error and row.tokens is None and row.repair == "failed"


def test_presets():
    assert Engine.from_server("http://x").backend.options.max_tokens == 1024
    assert Engine.from_pretrained("model").backend.options == backends.LOCAL
    assert backends.GREEDY.greedy and (backends.TUNED.max_tokens, backends.TUNED.top_p) == (256, 0.95)


def test_local_model_gets_batches_and_budgets(spark):
    def load():
        return lambda prompts, budgets: [f"{len(prompts)} {b}" for b in budgets]

    df = sources.from_sentences(spark, ["é", "four", "", "x"]).coalesce(1)
    got = Engine(Local(load, batch_size=3)).generate(df).orderBy("sent_id").collect()
    assert [r.response for r in got] == ["3 26", "3 42", "3 10", "1 18"] and all(r.backend_error is None for r in got)


def test_replay(spark):
    df = sources.from_sentences(spark, ["I am", "unseen"])
    prompt = codec.prompt(F.col("sentence"), F.lit("English"))
    recorded = df.filter("sent_id = 0").select(prompt.alias("prompt"), F.lit(GOOD).alias("response"))
    got = {r.sentence: r for r in Engine(Replay(recorded)).analyze(df).collect()}
    assert got["I am"].error is None and got["unseen"].error == "no recorded response"


def test_prompt_loop(spark, server):
    given, said = iter(["I am", "ENG", "bad", "xx", "quit"]), []
    prompt_loop.loop(spark, Engine(Http(server[0], Options(retries=0))), lambda _: next(given), said.append)
    assert len(said) == 3 and "Lemma: be" in said[1] and said[2].startswith("Remote endpoint") and sources.known_language(" XX") == "eng"


def token(text, pos="X"):
    return {"text": text, "whitespace": "", "pos": pos, "lemma": text, "dep": "root", "head": 0}


def test_corpus_files(spark, tmp_path, capsys):
    rows = [{"sentence": f"s{i}", ("doc" if i % 2 else "tokens"): [token(f"t{i}")]} for i in range(2000)] + [{"sentence": "bare"}]
    for name in ("cleaned_eng", "eng"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    (tmp_path / "fra.jsonl").write_text(json.dumps(rows[0]) + "\n")
    got = sources.read_corpus(spark, str(tmp_path), ["eng", "deu"])
    assert got.count() == 2001 and "cleaned_deu.jsonl not found" in capsys.readouterr().out
    assert {r.sentence: [t.text for t in r.tokens] for r in got.filter("sentence in ('s0', 's1', 'bare')").collect()} == {"s0": ["t0"], "s1": ["t1"], "bare": []}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits
    try:
        first = sources.read_test_corpus(spark, str(tmp_path), ["eng", "fra", "kor"], max_samples=150)
        assert sorted((r.language, r.sentence) for r in first.collect()) == sorted([("eng", f"s{i}") for i in range(150)] + [("fra", "s0")])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sources.read_corpus(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "cleaned_spa.jsonl").write_text('{"sentence": "x"}\n{oops\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        sources.read_corpus(spark, str(tmp_path), ["spa"]).collect()
    samples = sources.from_samples(spark, rows[:2] + [rows[-1]], "eng").collect()
    assert [(r.sentence, [t.text for t in r.tokens]) for r in samples] == [("s0", ["t0"]), ("s1", ["t1"]), ("bare", [])]
    assert sources.first_row(got.orderBy("sentence")).sentence == "bare" and sources.first_row(got.limit(0)) is None


def labels(spark, rows):
    return spark.createDataFrame(rows, "sent_id long, language string, true_pos string, pred_pos string, true_lemma string, pred_lemma string, true_dep string, pred_dep string")


def test_evaluation(spark, tmp_path):
    rows = labels(spark, [(1, "eng", "A", "A", "x", "x", "d", "d"), (1, "eng", "A", "B", "x", "y", "d", "e"), (2, "fra", "C", "C", "x", "x", "d", "d")])
    got = {r.label: tuple(r)[1:] for r in evaluate.report(rows).collect()}
    assert got["A"] == (1.0, 0.5, 2 / 3, 2) and got["B"] == (0.0, 0.0, 0.0, 0) and got["accuracy"] == (2 / 3, 2 / 3, 2 / 3, 3)
    assert got["weighted avg"][1] == pytest.approx(2 / 3) and "micro avg" not in got
    some = {r.label: tuple(r)[1:] for r in evaluate.report(rows, most=2).collect()}
    assert some["micro avg"] == (0.5, 0.5, 0.5, 2) and "accuracy" not in some and set(some) == {"A", "B", "micro avg", "macro avg", "weighted avg"}
    none = rows.limit(0)
    assert tuple(evaluate.overall(none).first()) == (None, None, None, 0) and evaluate.report(none).collect() == []
    results = evaluate.evaluate(rows)
    text = evaluate.as_text(results)
    assert "pos accuracy: 0.667" in text and "weighted avg" in text and "eng: pos 0.500" in text
    sources.write_results(spark, results, f"{tmp_path}/r.json")
    assert set(json.loads((tmp_path / "r.json").read_text())) == {"pos_accuracy", "lemma_accuracy", "dep_accuracy", "language_scores"}
    assert evaluate.as_text(evaluate.evaluate(none)).startswith("pos accuracy: none")


def test_saved_percent_without_tokens(spark):
    df = spark.createDataFrame([("", ""), ("abcd", "abc")], "o string, n string")
    assert [r[0] for r in df.select(codec.saved_percent(F.col("o"), F.col("n"))).collect()] == [None, 25.0]
    assert [r[0] for r in df.select(codec.per_item(F.length("o"), F.lit(0))).collect()] == [None, None]


def test_streams(spark, tmp_path):
    schema = "sent_id long, sentence string, response string"
    spark.createDataFrame([(1, "I am", GOOD), (2, "I was", GOOD)], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    found = streaming.decoded(stream).select("sent_id", "sentence", "tokens", "error")
    patterns = spark.createDataFrame([(0, "be", ["be"])], PATTERN)
    for name, df in (("decoded", found), ("matches", streaming.matches(found.filter("error is null"), patterns, "lemma"))):
        streaming.to_parquet(df, f"{tmp_path}/{name}", f"{tmp_path}/c-{name}").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.sent_id, r.error is None) for r in spark.read.parquet(f"{tmp_path}/decoded").collect()) == [(1, True), (2, False)]
    assert [(r.sent_id, r.start, r.end) for r in spark.read.parquet(f"{tmp_path}/matches").collect()] == [(1, 1, 2)]


def test_empty_patterns_as_an_automaton_has_them(spark):
    tokens = [(w, "", "X", w, "dep", 0) for w in "abcab"]
    df = spark.createDataFrame([(1, tokens), (2, [])], f"sent_id long, tokens {TOKENS}")
    patterns = spark.createDataFrame([(0, "none", []), (1, "abd", ["a", "b", "d"]), (2, "bc", ["b", "c"])], PATTERN)
    got = sorted((r.end, r.start, r.matched_label) for r in sequence.find_all_with_empty(df, patterns).collect())
    assert got == [(3, 1, "bc")]  # after c the automaton is at the end of bc, after the others inside a pattern
    some = sequence.find_all_with_empty(df, patterns.filter("pattern_index <> 2"))
    assert sorted((r.end, r.start) for r in some.collect()) == [(3, 3)]


def test_batches(spark):
    df = sources.from_sentences(spark, [str(i) for i in range(23)])
    got = corpus.batches(df, 4).collect()
    assert sorted(s.sent_id for r in got for s in r.sentences) == list(range(23)) and max(len(r.sentences) for r in got) <= 4


def test_null_and_odd_responses(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, GOOD), (3, "a b", "1\ta\tnarnbsp\tX\ta\troot\t99999999999\n2\tb\tnone\tX\tb\tdep\t+0000000000000001\r")], "sent_id long, sentence string, response string")
    got = {r.sent_id: r for r in finish(df).collect()}
    assert (got[1].tokens, got[1].error, got[1].repair) == (None, None, "failed")
    assert got[2].repair == "failed" and got[2].error
    assert [t.head for t in got[3].tokens] == [-1, 1] and got[3].repair == "normalize" and not got[3].slipped


def test_deep_trees_and_long_white_space(spark):
    from tokenloom.functions.text import strip
    from tokenloom.operators import trees

    n = 20_000
    chain = [("t", "", "X", "t", "root" if i == 0 else "dep", i) for i in range(n)]
    nodes = trees.build(spark.createDataFrame([(1, chain)], f"sent_id long, tokens {TOKENS}"))
    assert nodes.agg(F.max("depth"), F.count("*"), F.max("up")).first() == (n - 1, n, n - 2)
    text = "a" + " " * 200_000 + "b "
    assert spark.createDataFrame([(text,)], "x string").select(strip(F.col("x"))).first()[0] == text[:-1]

import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenloom.functions.text import normal
from tokenloom.operators import dependency, sequence, trees
from tokenloom.operators.codec import decode, encode, fits_grammar, reconstruct
from tokenloom.operators.dependency import Tree
from tokenloom.operators.repair import align, repair
from tokenloom.schema import DEP, PATTERN, POS, TOKENS, TREE_PATTERN, WHITESPACE
from pyspark.sql import functions as F


def tok(text, ws="", lemma=None, dep="dep", head=0, pos="X"):
    return (text, ws, pos, lemma or text, dep, head)


def sents(spark, rows):
    return spark.createDataFrame(rows, f"sent_id long, sentence string, tokens {TOKENS}")


def test_domains():
    assert len(POS) == 18 and len(DEP) == 66 and len(WHITESPACE) == 8 and len(set(WHITESPACE)) == 8


@pytest.mark.parametrize(
    ("raw", "want"),
    [("café", "cafe"), ("crème brûlée", "creme brulee"), ("don’t", "don't"), ("“hello”", '"hello"'), ("hello—world", "hello-world"), ("hello…", "hello..."), ("a b c d", "a b c d"), ("a​b", "ab")],
)
def test_normal(raw, want):
    assert normal(raw) == want


REPAIRS = [
    ([("Hello", " "), ("world", "")], "Hello world", "exact", 2),
    ([("Hello", " "), ("world", ""), (".", "")], "Hello world", "drop_last", 2),
    ([("Hello", " "), ("world", " "), (".", "")], "Hello world", "drop_last_trim", 2),
    ([("Le", " "), ("cafe", " "), ("est", " "), ("ouvert", "")], "Le café est ouvert", "normalize", 4),
    ([("It's", " "), ("great", "")], "It’s great", "normalize", 2),
    ([("Hello", " "), ("world", "")], "Hello world", "normalize", 2),
    ([("Hello", " "), ("world", "")], "Goodbye world", "failed", 2),
    ([("Dibujala", ""), (".", "")], "Dibújela.", "failed", 2),
    ([("Dibujala", ""), (".", "")], "Dibújala.", "normalize", 2),
]


def test_repair(spark):
    df = sents(spark, [(i, s, [tok(*t) for t in ts]) for i, (ts, s, _, _) in enumerate(REPAIRS)])
    got = repair(df).withColumn("text", reconstruct(F.col("tokens"))).orderBy("sent_id").collect()
    for r, (_, s, how, n) in zip(got, REPAIRS):
        assert (r.repair, len(r.tokens)) == (how, n)
        assert how == "failed" or r.text == s
    assert align(["a"], [""], "b") is None


def test_decode_every_white_space_and_faults(spark):
    line = "1\ta\t{}\tX\ta\troot\t0"
    codes = [(c, w) for w, c in WHITESPACE.items()] + [("  ", " "), ("odd", "odd")]
    rows = [(i, line.format(c) + "\n2\tb\tnone\tX\tb\tdep\t1") for i, (c, _) in enumerate(codes)]
    rows += [(90, "Here's the token analysis:\n\n1\t a\tnone\tX\ta\tdep\tx\textra\n-----\n\nfew\tfields\n1\t b\tnbsp\tX\tb\tdep\t+7\n\n</analysis> 3\tz\tnone\tX\tz\tdep\t1"), (91, "1\ta\tnone\tX\ta\tROOT\t0"), (92, "1\ta\tnone\tFOO\ta\troot\t0"), (93, "")]
    got = {r.sent_id: r for r in decode(spark.createDataFrame(rows, "sent_id long, response string")).collect()}
    for i, (_, w) in enumerate(codes):
        assert got[i].tokens[0].whitespace == w
    assert [tuple(t) for t in got[90].tokens] == [("a", " ", "X", "a", "dep", -1), ("b", " ", "X", "b", "dep", 7)]
    assert (got[91].error, got[92].error, got[93].tokens) == ("Failed to parse dependency", "Failed to parse POS", [])


def test_round_trip(spark):
    tokens = [tok("I", " ", pos="PRON"), tok("do"), tok("n't", " "), tok("x", " "), tok(".", "")]
    df = sents(spark, [(1, "I don't x .", tokens), (2, "", [])]).withColumn("response", encode(F.col("tokens")))
    df = df.withColumn("fits", fits_grammar(F.col("response"), F.col("sentence")))
    got = decode(df).orderBy("sent_id").collect()
    assert [tuple(t) for t in got[0].tokens] == tokens and got[1].tokens == []


SEQUENCES = [
    ([["h", "e"], ["s", "h", "e"], ["h", "i", "s"], ["h", "e", "r", "s"]], list("ushers"), [(1, 1, 4), (0, 2, 4), (3, 2, 6)]),
    ([["1", "2", "3"], ["2", "3", "4"], ["3", "4"]], list("012345"), [(0, 1, 4), (1, 2, 5), (2, 3, 5)]),
    ([["a", "a"], ["a", "a", "a"]], list("aaa"), [(0, 0, 2), (1, 0, 3), (0, 1, 3)]),
    ([["x", "y", "z"]], list("abc"), []),
    ([], list("abc"), []),
]


@pytest.mark.parametrize(("patterns", "words", "want"), SEQUENCES)
def test_sequences(spark, patterns, words, want):
    p = spark.createDataFrame([(i, f"p{i}", x) for i, x in enumerate(patterns)], PATTERN)
    df = sents(spark, [(1, "", [tok(w) for w in words]), (2, "", [])])
    got = sequence.in_order(sequence.find_all(df, p)).collect()
    assert [(r.pattern_index, r.start, r.end) for r in got] == want
    assert [r.sent_id for r in sequence.contains(df, p).collect()] == ([1] if want else [])


def test_sequences_move_nothing_and_agree_with_the_join(spark, monkeypatch):
    rng = random.Random(3)
    words = [*"abcd", "", None]
    patterns = [[rng.choice(words) for _ in range(rng.randint(1, 4))] for _ in range(60)]
    p = spark.createDataFrame([(i, f"p{i}", x) for i, x in enumerate([*patterns, patterns[0]])], PATTERN)
    rows = [(i, "", [tok(rng.choice("abcd")) for _ in range(rng.choice((0, 1, 2, 30)))]) for i in range(200)]
    df = sents(spark, rows).unionByName(sents(spark, [(900, "", None), (901, "", [(None, "", "X", "", "dep", 0)] * 5)]))
    monkeypatch.setattr(sequence, "AT_ONCE", 40)
    found = sequence.find_all(df, p)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" not in plan  # n-grams stay where their sentences are
    monkeypatch.setattr(sequence, "SENT_BYTES", 0)
    joined = sequence.find_all(df, p)
    assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString() and found.dtypes == joined.dtypes
    got = sorted(map(repr, found.collect()))
    assert got == sorted(map(repr, joined.collect())) and len(got) > 1000


def test_empty_patterns_move_nothing_and_agree_with_the_join(spark, monkeypatch):
    rng = random.Random(4)
    patterns = [[], *([rng.choice("abcd") for _ in range(rng.randint(1, 3))] for _ in range(4)), []]
    p = spark.createDataFrame([(i, f"p{i}", x) for i, x in enumerate(patterns)], PATTERN)
    df = sents(spark, [(i, "", [tok(rng.choice("abcdefgh")) for _ in range(rng.choice((0, 1, 2, 30)))]) for i in range(200)])
    for some in (p, p.filter("size(pattern) = 0"), p.filter("size(pattern) > 0")):
        monkeypatch.setattr(sequence, "AT_ONCE", 40)
        found = sequence.find_all_with_empty(df, some)
        assert not {"Join", "Aggregate"} & set(re.findall("Join|Aggregate", found._jdf.queryExecution().optimizedPlan().toString()))
        monkeypatch.setattr(sequence, "SENT_BYTES", -1)
        joined = sequence.find_all_with_empty(df, some)
        monkeypatch.undo()
        assert sorted(map(repr, found.collect())) == sorted(map(repr, joined.collect())) and found.dtypes == joined.dtypes


def test_lemma_match_moves_nothing(spark):
    from tokenloom import queries

    plan = queries.queries()["lemma_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_text_match_moves_nothing(spark):
    from tokenloom import queries

    plan = queries.queries()["text_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def whole_and_unmoved(spark, folder, name):
    """The query over many files with odd texts: no exchange in the plan that ran, and the rows of its SQL."""
    import duckdb
    from tokenloom import queries

    texts = ["Of the in the IN THE Of the.\n\n\nof\nthe end", None, "", "\n", "of  the\tof the éof THE the the", "the " * 3000, "…of—the… 12 the34 \U0001f600 the\r\nof the", "de la der die. the."]
    (folder / "documents.parquet").mkdir()
    for i, text in enumerate(texts):
        columns = {"doc_id": pa.array([i], pa.int64()), "text": pa.array([text], pa.string()), "lang": pa.array(["en"])}
        pq.write_table(pa.table(columns), folder / f"documents.parquet/{i}.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with patterns of unknown size, whose join deals n-grams out
    try:
        found = queries.queries()[name](spark, str(folder))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    assert got == sorted(want) and len(want) > 6000


def test_lemma_match_is_whole_without_an_exchange(spark, tmp_path):
    whole_and_unmoved(spark, tmp_path, "lemma_match")


def test_text_match_is_whole_without_an_exchange(spark, tmp_path):
    whole_and_unmoved(spark, tmp_path, "text_match")


def test_empty_patterns_are_refused(spark):
    with pytest.raises(ValueError):
        sequence.lengths(spark.createDataFrame([(0, "e", [])], PATTERN))


def test_trees_and_cycles(spark):
    love = [tok("I", dep="nsubj", head=2), tok("love", dep="root"), tok("programming", dep="obj", head=2), tok(".", dep="punct", head=2)]
    cycle = [tok("a", dep="root", head=2), tok("b", dep="obj", head=1)]
    none = [tok("a", dep="obj", head=2), tok("b", dep="obj", head=1)]
    nodes = trees.build(sents(spark, [(1, "", love), (2, "", cycle), (3, "", none)]))
    got = [(r.sent_id, tuple(r.path), r.terminal) for r in trees.paths(nodes).orderBy("sent_id", "pre").collect()]
    assert got == [(1, (2,), False), (1, (2, 1), False), (1, (2, 3), False), (1, (2, 4), False), (2, (1,), False), (2, (1, 2), False), (2, (1, 2, 1), True)]
    leaf = Tree.of
    patterns = [("a", leaf("love", ("obj", leaf("programming")))), ("b", leaf("love", ("nsubj", leaf("I")), ("obj", leaf("programming")))), ("c", leaf("love", ("obj", leaf("coding")))), ("d", leaf("I")), ("e", leaf("love", ("obj", leaf("x")), ("obj", leaf("programming"))))]
    found = dependency.find_all(nodes, dependency.pattern_table(spark, patterns)).orderBy("pre", "pattern_index").collect()
    assert [(r.node, r.matched_label) for r in found if r.sent_id == 1] == [(2, "a"), (2, "b"), (2, "e"), (1, "d")]


def test_paths_come_with_the_tree(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for s in range(150):
        n = rng.choice((1, 2, 5, 12))
        rows.append((s, "", [tok("t", lemma=f"w{i}", dep=rng.choice(["x", "y", "root"]), head=rng.randint(-1, n)) for i in range(n)]))
    rows += [(900, "", [tok("t", dep="root" if i == 0 else "x", head=i or 300) for i in range(300)]), (901, "", []), (902, "", None)]
    df = sents(spark, rows)
    whole = trees.build(df, dotted=True)
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()
    want = trees.paths(trees.build(df)).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "."))
    got = sorted(map(repr, whole.collect()))
    assert got == sorted(map(repr, want.select(whole.columns).collect())) and len(got) > 500
    cycle = whole.filter("sent_id = 900").orderBy("pre").collect()
    assert len(cycle) == 301 and cycle[-1].terminal and cycle[-1].path == ".".join(map(str, [*range(1, 301), 1]))
    # level by level, by sentence and in small pieces alike
    values = [(s, [t[5] for t in ts], [t[3] for t in ts], [t[4] for t in ts]) for s, _, ts in rows if ts]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*values, strict=True)], ("sent_id", "heads", "lemmas", "deps"))
    for levels, at_once in ((1, 10), (3, 10_000), (1000, 10_000)):
        monkeypatch.setattr(trees, "LEVELS", levels)
        monkeypatch.setattr(trees, "AT_ONCE", at_once)
        again = sorted(repr(tuple(r.values())) for b in trees._build(iter([batch]), dotted=True) for r in b.to_pylist())
        assert again == sorted(repr(tuple(r)) for r in whole.collect())


def brute_trees(heads, deps, lemmas):
    first = next((i for i, (h, d) in enumerate(zip(heads, deps), 1) if d == "root" or h == i), None)
    if first is None:
        return None

    def build(i, path):
        cut = i in path[:-1]
        return (lemmas[i - 1], path, [] if cut else [(deps[c - 1], build(c, (*path, c))) for c, h in enumerate(heads, 1) if h == i and c != i])

    return build(first, (first,))


def brute_match(node, pattern):
    return node[0] == pattern.lemma and all(any(d == dep and brute_match(c, child) for d, c in node[2]) for dep, child in dict(pattern.children).items())


def test_tree_patterns_against_brute_force(spark):
    rng = random.Random(5)
    leaf = lambda depth: Tree(rng.choice("ab"), tuple((rng.choice("xyz"), leaf(depth - 1)) for _ in range(rng.randint(0, 2) if depth else 0)))
    patterns = [(f"p{i}", leaf(3)) for i in range(30)]
    rows, want = [], set()
    for s in range(120):
        n = rng.randint(1, 9)
        heads, deps, lemmas = [rng.randint(-1, n) for _ in range(n)], [rng.choice(["x", "y", "z", "root"]) for _ in range(n)], [rng.choice("ab") for _ in range(n)]
        rows.append((s, "", [tok("t", lemma=w, dep=d, head=h) for h, d, w in zip(heads, deps, lemmas)]))
        stack = [brute_trees(heads, deps, lemmas)]
        while stack:
            if (node := stack.pop()) is not None:
                want |= {(s, node[1], i, label) for i, (label, p) in enumerate(patterns) if brute_match(node, p)}
                stack += [c for _, c in node[2]]
    nodes = trees.build(sents(spark, rows))
    got = dependency.find_all(nodes, dependency.pattern_table(spark, patterns)).join(trees.paths(nodes).select("sent_id", "pre", "path"), ["sent_id", "pre"]).collect()
    assert len(got) == len(want) and {(r.sent_id, tuple(r.path), r.pattern_index, r.matched_label) for r in got} == want
    assert any(p.children and label in {w[3] for w in want} for label, p in patterns)
    none = dependency.find_all(nodes, spark.createDataFrame([], TREE_PATTERN))
    assert none.count() == 0


def test_a_sentence_as_pattern(spark):
    # two children by the same relation: the last counts
    one = [tok("love", dep="root"), tok("I", dep="nsubj", head=1), tok("we", dep="nsubj", head=1), tok("you", dep="obj", head=1)]
    two = [tok("love", dep="root"), tok("we", dep="nsubj", head=1), tok("you", dep="obj", head=1), tok("too", dep="advmod", head=1)]
    three = [tok("love", dep="root"), tok("I", dep="nsubj", head=1), tok("you", dep="obj", head=1)]
    nodes = trees.build(sents(spark, [(1, "", one), (2, "", two), (3, "", three)]))
    patterns = trees.as_patterns(nodes.filter("sent_id = 1"), "like_one")
    assert {(r.sent_id, r.matched_label) for r in dependency.find_all(nodes, patterns).collect()} == {(1, "like_one"), (2, "like_one")}


def test_grammar(spark):
    good = "1\tI\t_\tPRON\tI\tnsubj\t2\n2\tam\tnone\tAUX\tam\troot\t0"
    cases = [
        (f"Here's the token analysis:\n\n{good}\n\n</analysis>", "I am", True), (f"{good}\n-----\n{good}\n\n</analysis>", "I am", True), (good, "I am", False),
        (f"{good}\n\n</analysis>", "I a", False), (f"{good}\n\n</analysis>", "", False), (f"{good}\n\n\n</analysis>", "I am", False), ("\n\n</analysis>", "I am", False),
        (good.replace("root", "ROOT") + "\n\n</analysis>", "I am", False), (good.replace("\tI\t_", "\t[^]\\\t_") + "\n\n</analysis>", "I am [^]\\", True), (None, "I am", False),
    ]
    df = spark.createDataFrame([(i, r, s) for i, (r, s, _) in enumerate(cases)], "i int, response string, sentence string")
    got = {r.i: r.fits for r in df.select("i", fits_grammar(F.col("response"), F.col("sentence")).alias("fits")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)}


def test_oracles_name_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

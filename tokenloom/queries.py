"""One query for each operator over the whole generated documents, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backends, sources
from .backends import Synthetic
from .engine import Engine, finish
from .functions.text import ends_with_punctuation
from .operators import codec, corpus, dependency, evaluate, sequence, trees
from .operators.dependency import Tree
from .operators.repair import repair
from .plans import synthetic
from .schema import DEP, PATTERN, POS, WHITESPACE, WHITESPACE_VARIANTS, language_name

PATTERNS = [
    (0, "of_the", ["of", "the"]), (1, "the", ["the"]), (2, "and_the", ["and", "the"]), (3, "de_la", ["de", "la"]),
    (4, "the_again", ["the"]), (5, "der_die", ["der", "die"]), (6, "in_the_stop", ["the", "."]), (7, "never", ["zz", "zz", "zz"]), (8, "The", ["The"]),
]
TREES = [
    ("the_any", Tree.of("the")),
    ("the_of", Tree.of("the", ("obj", Tree.of("of")))),
    ("and_two", Tree.of("and", ("nsubj", Tree.of("the")), ("punct", Tree.of(",")))),
    ("deep", Tree.of("the", ("punct", Tree.of(".")))),
    ("of_the_of", Tree.of("of", ("obj", Tree.of("the", ("obl", Tree.of("of")))))),
    ("last_wins", Tree.of("the", ("obj", Tree.of("zz")), ("obj", Tree.of("of")))),
]


def _patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATTERNS, PATTERN)


def _a(spark, d):
    return synthetic.annotated(spark, d)


def _nodes(spark, d):
    return trees.build(_a(spark, d))


def _tree_patterns(spark):
    return dependency.pattern_table(spark, TREES)


def _pairs(spark, d):
    return evaluate.pairs(_a(spark, d), synthetic.predictions(spark, d))


def _tokens_flat(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode("tokens").alias("i", "t")).select(*keep, (F.col("i") + 1).cast("long").alias("idx"), "t.*")


def prompt_variants(spark, d):
    s = synthetic.sentences(spark, d)
    name = language_name(F.col("language"))
    return s.select("sent_id", *[codec.prompt(F.col("sentence"), name, v).alias(f"{v}_prompt") for v in codec.TAILS])


def encode_response(spark, d):
    return _a(spark, d).select("sent_id", codec.encode(F.col("tokens")).alias("response"))


def encode_full_text(spark, d):
    df = _a(spark, d)
    p = codec.prompt(F.col("sentence"), language_name(F.col("language"), strict=True), "training")
    return df.select("sent_id", F.md5(codec.full_text(p, codec.encode(F.col("tokens")))).alias("text_md5"))


def format_efficiency(spark, d):
    old, new = codec.verbose_format(F.col("tokens")), codec.compact_format(F.col("tokens"))
    return _a(spark, d).select("sent_id", F.length(old).alias("n_old"), F.length(new).alias("n_new"), codec.saved_percent(old, new).alias("saved_percent"))


def decode_tokens(spark, d):
    df = codec.decode(synthetic.responses(spark, d))
    return _tokens_flat(df.filter("error is null"), "sent_id")


def decode_errors(spark, d):
    return codec.decode(synthetic.responses(spark, d)).filter("error is not null").select("sent_id", "error")


def decode_lenient(spark, d):
    df = synthetic.responses(spark, d).select("sent_id", F.posexplode(codec.decode_lenient(F.col("response"))).alias("i", "t"))
    return df.select("sent_id", (F.col("i") + 1).cast("long").alias("place"), "t.*")


def head_parse(spark, d):
    df = synthetic.sentences(spark, d).select("sent_id", F.concat(F.element_at(F.array(*map(F.lit, ["", "+", "-", " ", "x", "0000", "9"])), (F.col("sent_id") % 7 + 1).cast("int")), (F.col("sent_id") * 7919).cast("string")).alias("raw"))
    return df.select("sent_id", "raw", codec.head_number(F.col("raw")).alias("head"))


def reconstruct_text(spark, d):
    df = _a(spark, d)
    text = codec.reconstruct(F.col("tokens"))
    return df.select("sent_id", F.md5(text).alias("text_md5"), (text == F.col("sentence")).alias("same"))


def repair_status(spark, d):
    return repair(codec.decode(synthetic.responses(spark, d))).select("sent_id", "repair", F.size("tokens").cast("long").alias("n_tokens"), "slipped", F.md5(codec.reconstruct(F.col("tokens"))).alias("text_md5"))


def analyze_replay(spark, d):
    s = _a(spark, d)
    engine = Engine(Synthetic(lambda: synthetic.faulty(codec.encode(F.col("tokens")), F.col("sent_id"))))
    out = finish(engine.generate(s, save=False).drop("tokens"))
    return out.select("sent_id", "error", F.size("tokens").cast("long").alias("n_tokens"))


def _matches(key):
    def run(spark, d):
        return sequence.find_all(_a(spark, d), _patterns(spark), key).drop("pattern")

    return run


def _contains(key):
    def run(spark, d):
        return sequence.contains(_a(spark, d), _patterns(spark).filter("pattern_index in (0, 3, 6)"), key).select("sent_id")

    return run


def match_counts_by_label(spark, d):
    found = sequence.find_all(_a(spark, d), _patterns(spark), "lemma")
    return found.groupBy("matched_label").agg(F.count("*").alias("n"), F.countDistinct("sent_id").alias("n_sentences"))


def pattern_count(spark, d):
    return _patterns(spark).agg(F.count("*").alias("n"))


def match_format(spark, d):
    return _patterns(spark).select("pattern_index", sequence.show_match(F.col("pattern")).alias("shown"))


def tree_roots(spark, d):
    return _a(spark, d).select("sent_id", trees.root(F.col("tokens")).alias("root"), trees.root_error(F.col("tokens")).alias("error"))


def tree_edges(spark, d):
    return trees.build(_a(spark, d), dotted=True).select("sent_id", "node", "parent", "dep", "depth", "path", "terminal")


def tree_depths(spark, d):
    return _nodes(spark, d).groupBy("sent_id").agg(F.max("depth").alias("depth"), F.count("*").alias("n_nodes"))


def dep_match(spark, d):
    found = dependency.find_all(_nodes(spark, d), _tree_patterns(spark))
    return found.select("sent_id", "node", "pattern_index", "matched_label")


def dep_contains(spark, d):
    return dependency.contains(_nodes(spark, d), _tree_patterns(spark).filter("pattern_index in (2, 4)"))


def dep_match_groups(spark, d):
    return dependency.by_pattern(dependency.find_all(_nodes(spark, d), _tree_patterns(spark)))


def corpus_process(spark, d):
    p = corpus.process(_a(spark, d))
    lists = ("tokens", "whitespaces", "pos_tags", "lemmas", "dep_tags", "dep_heads")
    return p.select("sent_id", "language_name", *[F.md5(F.array_join(c, "|")).alias(c) for c in lists])


def punct_filter(spark, d):
    return synthetic.sentences(spark, d).select("sent_id", ends_with_punctuation(F.col("sentence")).alias("ends"))


def corpus_groups(spark, d):
    return corpus.groups(synthetic.sentences(spark, d))


def corpus_split(spark, d):
    return corpus.split(corpus.groups(synthetic.sentences(spark, d))).select("sent_id", "number", "split")


def split_counts(spark, d):
    rows = corpus.split(corpus.groups(synthetic.sentences(spark, d)))
    return rows.groupBy("split").agg(F.countDistinct("number").alias("n_groups"), F.count("*").alias("n_sentences"))


def corpus_prompt_pairs(spark, d):
    return corpus.prompt_pairs(_a(spark, d)).select("number", "split", F.col("n_sentences").cast("long").alias("n_sentences"), "language", F.md5("prompt").alias("prompt_md5"), F.md5("response").alias("response_md5"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def eval_overall(spark, d):
    return _rounded(evaluate.overall(_pairs(spark, d)))


def eval_by_language(spark, d):
    return _rounded(evaluate.by_language(_pairs(spark, d)))


def eval_confusion(spark, d):
    return evaluate.confusion(_pairs(spark, d))


def eval_report(spark, d):
    return _rounded(evaluate.report(_pairs(spark, d)))


def eval_report_dep(spark, d):
    """Of the first four labels only, so that the summary is a micro average."""
    return _rounded(evaluate.report(_pairs(spark, d), "dep", 4))


def eval_decoded(spark, d):
    """What was decoded and repaired against the annotation; sentences with an error are left out."""
    return _rounded(evaluate.overall(evaluate.pairs(_a(spark, d), finish(synthetic.responses(spark, d)))))


def error_details(spark, d):
    out = finish(synthetic.responses(spark, d)).filter("error_detail is not null")
    return out.select("sent_id", *[F.md5(f"error_detail.{c}").alias(f"{c}_md5") for c in ("reconstructed", "sentence", "response")])


def texts_and_lemmas(spark, d):
    t = F.col("tokens")
    return _a(spark, d).select("sent_id", F.md5(F.array_join(codec.texts(t), " ")).alias("texts_md5"), F.md5(F.array_join(codec.lemmas(t), " ")).alias("lemmas_md5"), F.size(t).cast("long").alias("n_tokens"))


def analysis_extraction(spark, d):
    r = synthetic.responses(spark, d)
    whole = F.concat(codec.prompt(F.col("sentence"), language_name(F.col("language")), "inference"), F.lit("  "), F.col("response"), F.lit("\n"))
    return r.select("sent_id", F.md5(codec.analysis(whole)).alias("analysis_md5"))


def empty_pattern_match(spark, d):
    patterns = spark.createDataFrame([(0, "none", []), (1, "of_the", ["of", "the"]), (2, "the", ["the"])], PATTERN)
    return sequence.find_all_with_empty(_a(spark, d), patterns).drop("pattern")


def dep_find_multiple(spark, d):
    found = dependency.find_multiple(_nodes(spark, d), _tree_patterns(spark))
    return found.select("sent_id", "pattern_index", "matched_label", F.size("nodes").cast("long").alias("n_nodes"), F.array_join(F.transform(F.array_sort("nodes"), lambda x: x.cast("string")), " ").alias("nodes"))


def corpus_scan(spark, d):
    """Written as one folder of JSON lines for each language, some under the older key, and read back."""
    folder = sources.scratch(spark, "corpus")
    df = _a(spark, d).select("sent_id", "language", "sentence", "tokens")
    old = F.col("sent_id") % 4 == 0
    line = F.to_json(F.struct("sentence", F.when(~old, F.col("tokens")).alias("tokens"), F.when(old, F.col("tokens")).alias("doc")))
    df.select(F.concat(F.lit("cleaned_"), "language", F.lit(".jsonl")).alias("file"), line.alias("value")).write.partitionBy("file").text(folder)
    languages = [r.language for r in df.select("language").distinct().collect()]  # languages are few
    got = sources.read_corpus(spark, folder, languages, "{folder}/file=cleaned_{code}.jsonl")
    lemmas = F.array_join("tokens.lemma", " ")
    return got.groupBy("language", F.md5("sentence").alias("sentence_md5"), F.size("tokens").cast("long").alias("n_tokens"), F.md5(lemmas).alias("lemmas_md5")).agg(F.count("*").alias("n"))


def eos_check(spark, d):
    pairs = corpus.prompt_pairs(_a(spark, d))
    return pairs.groupBy("split").agg(F.count("*").alias("n"), F.sum((~F.endswith("full_text", F.lit("<eos>"))).cast("long")).alias("n_lacking"))


def format_per_item(spark, d):
    old, new = codec.verbose_format(F.col("tokens")), codec.compact_format(F.col("tokens"))
    n = F.size("tokens")
    each = lambda x, of=None: codec.per_item(F.length(x), n, of)
    return _a(spark, d).select("sent_id", each(old).alias("old_per_item"), each(new).alias("new_per_item"), each(old, 10).alias("old_of_ten"), each(new, 10).alias("new_of_ten"))


def pos_dep_domain_check(spark, d):
    t = _tokens_flat(_a(spark, d), "sent_id")
    return t.groupBy("pos", "dep").agg(F.count("*").alias("n"), F.min(F.col("pos").isin(POS) & F.col("dep").isin(DEP)).alias("known"))


def grammar_check(spark, d):
    return synthetic.responses(spark, d).select("sent_id", codec.fits_grammar(F.col("response"), F.col("sentence")).alias("fits"))


def limit_per_language(spark, d):
    return sources.first_per_group(synthetic.sentences(spark, d), "language", ["sent_id"], 50).select("language", "sent_id")


def latest_checkpoint(spark, d):
    paths = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.when(F.col("doc_id") % 3 == 0, "run/checkpoint-").otherwise("run/other-"), F.col("doc_id").cast("string")).alias("path"))
    return sources.latest_checkpoint(paths)


def json_round_trip(spark, d):
    df = _a(spark, d).withColumn("json", sources.to_json()).select("sent_id", sources.from_json(F.col("json")).alias("t"))
    field = lambda c: F.md5(F.array_join(F.transform("t", lambda x: x[c].cast("string")), " ")).alias(f"{c}_md5")
    return df.select("sent_id", *[field(c) for c in ("text", "whitespace", "pos", "lemma", "dep", "head")])


def token_budget(spark, d):
    return synthetic.sentences(spark, d).select("sent_id", backends.token_budget(F.col("sentence")).cast("long").alias("max_tokens"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        prompt_variants, encode_response, encode_full_text, format_efficiency, decode_tokens, decode_errors, decode_lenient, head_parse, reconstruct_text,
        repair_status, analyze_replay, match_counts_by_label, pattern_count, match_format, tree_roots, tree_edges, tree_depths, dep_match, dep_contains,
        dep_match_groups, corpus_process, punct_filter, corpus_groups, corpus_split, split_counts, corpus_prompt_pairs, eval_overall, eval_by_language,
        eval_confusion, eval_report, pos_dep_domain_check, grammar_check, limit_per_language, latest_checkpoint, json_round_trip, token_budget,
        eval_report_dep, eval_decoded, error_details, texts_and_lemmas, analysis_extraction, empty_pattern_match, dep_find_multiple, corpus_scan, eos_check, format_per_item,
    )
    found = {f.__name__: f for f in plain}
    return found | {f"{k}_match": _matches(k) for k in ("text", "lemma")} | {f"{k}_contains": _contains(k) for k in ("text", "lemma")}


# The same in SQL. sent, tok: sentences and tokens; clean, resp: responses; line, dec: decoded tokens.
SENT = r"""
sent AS (
  SELECT CAST(doc_id * 100000 + i AS BIGINT) AS sent_id,
         CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' ELSE lang END AS language, s AS sentence
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE s <> ''
)"""
TOK = SENT + r""",
found AS (
  SELECT sent_id, language, sentence, len(f) AS n, unnest(f) AS x, generate_subscripts(f, 1) AS idx
  FROM (SELECT *, regexp_extract_all(sentence, '(?:[\p{L}\p{N}]+|[^ \x09\x0B\x0C\x0D\p{L}\p{N}]) ?') AS f FROM sent)
),
tok AS (
  SELECT sent_id, language, sentence, CAST(idx AS BIGINT) AS idx, rtrim(x, ' ') AS text, CASE WHEN suffix(x, ' ') THEN ' ' ELSE '' END AS whitespace,
         CASE WHEN NOT regexp_matches(x, '^[\p{L}\p{N}]') THEN 'PUNCT' WHEN regexp_matches(x, '^[0-9]+ ?$') THEN 'NUM'
              ELSE (['NOUN','VERB','ADJ','DET','ADP'])[length(rtrim(x, ' ')) % 5 + 1] END AS pos,
         lower(rtrim(x, ' ')) AS lemma,
         CASE WHEN idx = 1 OR (idx = 3 AND sent_id % 17 = 0) THEN 'root' WHEN NOT regexp_matches(x, '^[\p{L}\p{N}]') THEN 'punct' ELSE (['nsubj','obj','obl','det','amod','advmod'])[idx % 6 + 1] END AS dep,
         CAST(CASE WHEN idx = 1 AND sent_id % 13 = 0 AND n > 1 THEN 2 ELSE idx // 2 END AS INTEGER) AS head, n
  FROM found
)"""
CLEAN = TOK + r""",
moved AS (
  SELECT *, CASE WHEN lag(whitespace) OVER w = ' ' THEN ' ' || text ELSE text END AS moved_text, CASE WHEN whitespace = ' ' AND idx < n THEN '' ELSE whitespace END AS moved_ws
  FROM tok WINDOW w AS (PARTITION BY sent_id ORDER BY idx)
),
lines AS (
  SELECT sent_id, string_agg(idx || chr(9) || moved_text || chr(9) || CASE moved_ws WHEN '' THEN 'none' ELSE '_' END || chr(9) || pos || chr(9) || lemma || chr(9) || dep || chr(9) || head, chr(10) ORDER BY idx) AS body
  FROM moved GROUP BY sent_id
),
clean AS (
  SELECT sent_id, language, sentence, 'Here''s the token analysis:' || chr(10) || chr(10) || coalesce(body, '') || chr(10) || chr(10) || '</analysis>' AS response
  FROM sent LEFT JOIN lines USING (sent_id)
)"""
RESP = CLEAN + r""",
e AS (SELECT chr(10) || chr(10) || '</analysis>' AS ending, 'Here''s the token analysis:' || chr(10) || chr(10) AS opening, chr(9) AS t),
resp AS (
  SELECT sent_id, language, sentence, CASE sent_id % 10
    WHEN 0 THEN translate(response, 'éèêöüäñó', 'eeeouano')
    WHEN 1 THEN replace(response, ending, chr(10) || '99' || t || '.' || t || 'none' || t || 'PUNCT' || t || '.' || t || 'punct' || t || '1' || ending)
    WHEN 2 THEN replace(response, opening, '')
    WHEN 3 THEN replace(response, t || 'root' || t || '0', t || 'root' || t || 'x0')
    WHEN 4 THEN replace(response, t || 'DET' || t, t || 'FOO' || t)
    WHEN 5 THEN replace(response, ending, '')
    WHEN 6 THEN replace(response, chr(10) || '2' || t, chr(10) || '2 ')
    WHEN 7 THEN replace(response, ending, chr(10) || '99' || t || ' !' || t || 'none' || t || 'PUNCT' || t || '!' || t || 'punct' || t || '1' || ending)
    WHEN 8 THEN replace(response, t || 'root' || t, t || 'ROOT' || t)
    ELSE replace(response, t || 'none' || t, t || ([{codes}])[(sent_id // 10) % {n_codes} + 1] || t) END AS response
  FROM clean, e
)""".replace("{codes}", ", ".join(f"'{c}'" for c in synthetic.CODES)).replace("{n_codes}", str(len(synthetic.CODES)))
WHITE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIP = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim(x: str, white: str = WHITE) -> str:
    return f"regexp_replace({x}, '^{white}+|{white}+$', '', 'g')"


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_CODES = " ".join(f"WHEN '{code}' THEN '{char}'" for code, char in [*((c, w) for w, c in WHITESPACE.items()), *WHITESPACE_VARIANTS.items()])
_BODY = _trim("string_split(list_last(string_split(response, 'Here''s the token analysis:')), '</analysis>')[1]")
DEC = RESP + rf""",
raw AS (
  SELECT sent_id, sentence, line, place FROM (
    SELECT sent_id, sentence, {_trim('unnest(ls)')} AS line, generate_subscripts(ls, 1) AS place
    FROM (SELECT sent_id, sentence, string_split({_BODY}, chr(10)) AS ls FROM resp)
  ) WHERE line <> '' AND line <> '-----' AND len(string_split(line, chr(9))) >= 7
),
fields AS (SELECT sent_id, sentence, string_split(line, chr(9)) AS p, row_number() OVER (PARTITION BY sent_id ORDER BY place) AS idx FROM raw),
dec AS (
  SELECT sent_id, sentence, idx, CASE WHEN prefix(p[2], ' ') THEN substr(p[2], 2) ELSE p[2] END AS text,
         CASE WHEN prefix(coalesce(lead(p[2]) OVER w, ''), ' ') THEN ' ' ELSE CASE p[3] {_CODES} ELSE p[3] END END AS whitespace,
         p[4] AS pos, p[5] AS lemma, p[6] AS dep,
         CASE WHEN regexp_matches(p[7], '^[+-]?[0-9]+$') THEN coalesce(try_cast(p[7] AS INTEGER), -1) ELSE -1 END AS head
  FROM fields WINDOW w AS (PARTITION BY sent_id ORDER BY idx)
),
bad AS (
  SELECT sent_id, arg_min(CASE WHEN pos NOT IN ({_quoted(POS)}) THEN 'Failed to parse POS' ELSE 'Failed to parse dependency' END, idx) AS error
  FROM dec WHERE pos NOT IN ({_quoted(POS)}) OR dep NOT IN ({_quoted(DEP)}) GROUP BY sent_id
)"""
REP = DEC + r""",
place AS (
  SELECT sent_id, sentence, idx, text, whitespace, coalesce(sum(length(text) + length(whitespace)) OVER (PARTITION BY sent_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM dec
),
agg AS (
  SELECT sent_id, count(*) AS n, string_agg(text || whitespace, '' ORDER BY idx) AS whole, coalesce(string_agg(text, '' ORDER BY idx) FILTER (begins >= length(sentence)), '') AS beyond
  FROM place GROUP BY sent_id
),
short AS (
  SELECT sent_id, string_agg(text || whitespace, '' ORDER BY idx) AS part FROM (SELECT *, max(idx) OVER (PARTITION BY sent_id) AS top FROM dec) WHERE idx < top GROUP BY sent_id
),
state AS (
  SELECT r.sent_id, r.sentence, coalesce(n, 0) AS n, coalesce(whole, '') AS whole, coalesce(beyond, '') AS beyond, part, error,
    CASE WHEN error IS NOT NULL THEN 'failed' WHEN coalesce(whole, '') = r.sentence THEN 'exact' WHEN part = r.sentence THEN 'drop_last'
         WHEN regexp_replace(part, '[ \x{202F}]+$', '') = r.sentence THEN 'drop_last_trim'
         WHEN strip_accents(replace(coalesce(whole, ''), chr(8203), '')) = strip_accents(r.sentence) THEN 'normalize' ELSE 'failed' END AS repair
  FROM resp r LEFT JOIN agg USING (sent_id) LEFT JOIN short USING (sent_id) LEFT JOIN bad USING (sent_id)
)"""
PRED = TOK + r""",
pair AS (
  SELECT sent_id, language, idx, pos AS true_pos, lemma AS true_lemma, dep AS true_dep,
         CASE WHEN (idx - 1 + sent_id) % 7 = 0 THEN 'X' ELSE pos END AS pred_pos,
         CASE WHEN (idx - 1 + sent_id) % 11 = 0 THEN lemma || 'x' ELSE lemma END AS pred_lemma,
         CASE WHEN (idx - 1 + sent_id) % 5 = 0 THEN 'dep' ELSE dep END AS pred_dep
  FROM tok WHERE NOT (sent_id % 3 = 0 AND idx = n)
)"""
_ENDS = f"contains('.!?:;।。！？؟¿¡', right({_trim('sentence', STRIP)}, 1)) AND {_trim('sentence', STRIP)} <> ''"
GROUPS = rf""",
draws AS (
  SELECT sent_id, {_ENDS} AS ends, md5('0:' || sent_id) AS digest, CAST('0x' || substr(md5('0:k:' || sent_id), 1, 6) AS INTEGER) AS number FROM sent
),
ranked AS (
  SELECT sent_id, ends, substr(digest, 1, 2) AS shard, CAST(row_number() OVER (PARTITION BY substr(digest, 1, 2) ORDER BY digest, sent_id) AS INTEGER) AS rank,
         CASE WHEN number % 10 = 0 THEN 0 ELSE 1 + (number // 10) % 4 END AS k
  FROM draws
),
following AS (
  SELECT *, CASE WHEN NOT ends OR k = 0 THEN 0 ELSE least(k,
      CASE WHEN NOT coalesce(lead(ends, 1) OVER w, true) THEN 1 WHEN NOT coalesce(lead(ends, 2) OVER w, true) THEN 2 WHEN NOT coalesce(lead(ends, 3) OVER w, true) THEN 3 ELSE 4 END,
      count(*) OVER (PARTITION BY shard) - rank) END AS m
  FROM ranked WINDOW w AS (PARTITION BY shard ORDER BY rank)
),
starts(shard, rank, m) AS (
  SELECT shard, rank, m FROM following WHERE rank = 1
  UNION ALL
  SELECT f.shard, f.rank, f.m FROM starts s JOIN following f ON f.shard = s.shard AND f.rank = s.rank + s.m + 1
),
member AS (
  SELECT f.sent_id, f.shard, f.rank, s.rank AS group_start FROM following f JOIN starts s ON f.shard = s.shard AND f.rank BETWEEN s.rank AND s.rank + s.m
),
numbers AS (SELECT shard, rank AS group_start, row_number() OVER (ORDER BY shard, rank) - 1 AS number, count(*) OVER () AS total FROM starts),
splits AS (
  SELECT sent_id, rank, CAST(number AS BIGINT) AS number,
         CASE WHEN number < CAST(floor(total * CAST(0.9 AS DOUBLE)) AS BIGINT) THEN 'train'
              WHEN number < CAST(floor(total * CAST(0.9 AS DOUBLE)) AS BIGINT) + CAST(floor(total * CAST(0.05 AS DOUBLE)) AS BIGINT) THEN 'validation' ELSE 'test' END AS split
  FROM member JOIN numbers USING (shard, group_start)
)"""
_NAMES = "CASE language WHEN 'eng' THEN 'English' WHEN 'deu' THEN 'German' WHEN 'fra' THEN 'French' WHEN 'spa' THEN 'Spanish' ELSE language END"


def _pattern_sql() -> str:
    rows = ", ".join(f"({i}, '{label}', [{_quoted(p)}], {len(p)})" for i, label, p in PATTERNS)
    return f", pat AS (SELECT * FROM (VALUES {rows}) AS t(pattern_index, label, pattern, size))"


def _match_sql(key: str) -> str:
    most = max(len(p) for _, _, p in PATTERNS)
    leads = ", ".join(f"lead({key}, {k}) OVER w" for k in range(most))
    return TOK + _pattern_sql() + f""",
near AS (SELECT sent_id, idx, n, [{leads}] AS g FROM tok WINDOW w AS (PARTITION BY sent_id ORDER BY idx)),
hits AS (
  SELECT sent_id, CAST(pattern_index AS INTEGER) AS pattern_index, CAST(idx - 1 AS INTEGER) AS start, CAST(idx - 1 + size AS INTEGER) AS "end", label AS matched_label
  FROM near JOIN pat ON g[1] = pattern[1] WHERE idx - 1 + size <= n AND g[1:size] = pattern
)"""


WALK = r""",
walk(sent_id, node, parent, dep, lemma, depth, path, up, terminal) AS (
  SELECT sent_id, CAST(1 AS INTEGER), CAST(NULL AS INTEGER), dep, lemma, 0, '1', CAST(NULL AS VARCHAR), false FROM tok WHERE idx = 1
  UNION ALL
  SELECT w.sent_id, CAST(t.idx AS INTEGER), w.node, t.dep, t.lemma, w.depth + 1, w.path || '.' || t.idx, w.path, t.idx = 1
  FROM walk w JOIN tok t ON t.sent_id = w.sent_id AND t.head = w.node WHERE NOT w.terminal
)"""


def _dep_sql() -> str:
    """Each pattern as self-joins of the trees' nodes on their parent."""
    parts = []
    for index, (label, tree) in enumerate(TREES):
        joins, number, stack = [], 0, [(tree, "t0")]
        conditions = [f"t0.lemma = '{tree.lemma}'"]
        while stack:
            node, alias = stack.pop()
            for dep, child in dict(node.children).items():
                number += 1
                joins.append(f"JOIN walk t{number} ON t{number}.sent_id = t0.sent_id AND t{number}.up = {alias}.path AND t{number}.dep = '{dep}' AND t{number}.lemma = '{child.lemma}'")
                stack.append((child, f"t{number}"))
        parts.append(f"SELECT DISTINCT t0.sent_id, t0.path, t0.node, {index} AS pattern_index, '{label}' AS matched_label FROM walk t0 {' '.join(joins)} WHERE {' AND '.join(conditions)}")
    return TOK + WALK + ", deps AS (" + " UNION ALL ".join(parts) + ")"


def _grammar_sql() -> str:
    """Lines of the body between opening and ending, each held against the grammar; words by their set of characters."""
    pos, dep = "|".join(p for p in POS if p != "SPACE"), "|".join(x for x in DEP if ":" not in x)
    line = rf"^[0-9]+\t[^\t]+\t(_|none|nbsp|thinsp|hairsp|zwsp|ideogrp)\t({pos})\t[^\t]+\t({dep})\t-?[0-9]+$"
    return RESP + rf""",
body AS (
  SELECT sent_id, sentence, suffix(response, ending) AS ended,
         string_split(replace(CASE WHEN prefix(response, opening) THEN substr(response, length(opening) + 1, length(response) - length(opening) - length(ending))
                              ELSE substr(response, 1, length(response) - length(ending)) END, chr(10) || '-----' || chr(10), chr(10)), chr(10)) AS ls
  FROM resp, e
),
each AS (SELECT sent_id, sentence, ended, unnest(ls) AS line FROM body)
SELECT sent_id, bool_and(ended AND regexp_matches(line, '{line}')
  AND len(list_filter(string_split(coalesce(string_split(line, chr(9))[2], '') || coalesce(string_split(line, chr(9))[5], ''), ''), lambda c: NOT contains(sentence, c))) = 0) AS fits
FROM each GROUP BY sent_id"""


def _with(prelude: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{prelude.strip()}\n{select}"


def oracle_sql() -> dict[str, str]:
    nl = "chr(10)"
    task = "'Task: Analyze tokens (idx,token,ws,POS,lemma,dep,head)'"
    head = f"'Language: ' || {_NAMES} || {nl} || 'Sentence: ' || sentence || {nl}"
    accuracy = ", ".join(f"round(count(*) FILTER (true_{x} = pred_{x}) / count(*), 9) AS {x}_accuracy" for x in evaluate.LABELS)
    correct = ", ".join(f"count(*) FILTER (true_{x} = pred_{x}) AS {x}_correct" for x in evaluate.LABELS)
    flat = "sent_id, idx, text, whitespace, pos, lemma, dep, head"
    lenient = RESP + rf""",
lines2 AS (
  SELECT sent_id, {_trim('unnest(ls)', STRIP)} AS line, generate_subscripts(ls, 1) AS place
  FROM (SELECT sent_id, string_split({_trim("list_last(string_split(response, 'Here''s the token analysis:'))", STRIP)}, chr(10)) AS ls FROM resp)
),
f2 AS (SELECT sent_id, place, string_split(line, chr(9)) AS p FROM lines2 WHERE len(string_split(line, chr(9))) >= 7)"""
    names = ("index", "token", "whitespace", "pos", "lemma", "dep", "head")
    lenient_cols = ", ".join(f"CASE WHEN {_trim(f'p[{i}]', STRIP)} = '_' THEN ' ' ELSE {_trim(f'p[{i}]', STRIP)} END AS {n}" if n == "whitespace" else f'{_trim(f"p[{i}]", STRIP)} AS "{n}"' for i, n in enumerate(names, 1))
    old = "(idx - 1) || ': ' || text || ' | POS: ' || pos || ' | Lemma: ' || lemma || ' | Dep: ' || dep || ' | Head: ' || head"
    new = "(idx - 1) || chr(9) || text || chr(9) || pos || chr(9) || lemma || chr(9) || dep || chr(9) || head"
    aggregated = lambda x, sep="chr(10)": f"coalesce(string_agg({x}, {sep} ORDER BY idx), '')"
    report = PRED + r""",
conf AS (SELECT true_pos AS t, pred_pos AS p, count(*) AS n FROM pair GROUP BY ALL),
all_sums AS (
  SELECT label, sum(s) AS support, sum(g) AS guessed, sum(r) AS hits FROM (
    SELECT t AS label, n AS s, 0 AS g, CASE WHEN t = p THEN n ELSE 0 END AS r FROM conf UNION ALL SELECT p, 0, n, 0 FROM conf
  ) GROUP BY label
),
whole AS (SELECT count(*) <= 20 AS whole FROM all_sums),
sums AS (SELECT * FROM all_sums ORDER BY label LIMIT 20),
each AS (
  SELECT *, CASE WHEN guessed = 0 THEN 0 ELSE hits / guessed END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall FROM sums
),
full_ AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM each),
rep AS (
  SELECT label, precision, recall, f1, support FROM full_
  UNION ALL SELECT CASE WHEN whole THEN 'accuracy' ELSE 'micro avg' END, CASE WHEN whole THEN r ELSE p END, r, CASE WHEN whole THEN r ELSE 2 * p * r / (p + r) END, s
    FROM (SELECT sum(hits) / sum(guessed) AS p, sum(hits) / sum(support) AS r, sum(support) AS s FROM full_), whole
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM full_
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM full_
)"""
    budget = "CAST(10 + 8 * strlen(sentence) AS BIGINT)"
    moved_lists = {"tokens": "moved_text", "whitespaces": "moved_ws", "pos_tags": "pos", "lemmas": "lemma", "dep_tags": "dep", "dep_heads": "CAST(head AS VARCHAR)"}
    grouped = CLEAN + GROUPS + rf""",
bodies AS (
  SELECT s.number, s.split, s.rank, c.language, {_trim('c.sentence', STRIP)} AS stripped, coalesce(l.body, '') AS body, l.body IS NOT NULL AS has_lines
  FROM splits s JOIN sent c USING (sent_id) LEFT JOIN lines l USING (sent_id)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY rank) AS place FROM bodies),
grp AS (
  SELECT number, any_value(split) AS split, count(*) AS n_sentences, arg_min(language, rank) AS language, string_agg(stripped, ' ' ORDER BY rank) AS sentence,
         string_agg(CASE WHEN place > 1 AND has_lines THEN '1' || chr(9) || ' ' || substr(body, 3) ELSE body END, chr(10) || '-----' || chr(10) ORDER BY rank) AS body
  FROM placed GROUP BY number
)"""
    tok_md5 = "coalesce(string_agg(text || whitespace, '' ORDER BY idx), '')"
    out = {
        "prompt_variants": _with(SENT, f"SELECT sent_id, {head} || {task} || {nl} || {nl} || 'Analysis:' || {nl} AS request_prompt, {head} || {task} || {nl} || {nl} || 'Analysis:' AS inference_prompt, "
                                 f"{head} || 'Task: Analyze tokens (idx,token,POS,lemma,dep,head)' || {nl} || {nl} || 'Analysis:' AS legacy_prompt, {head} || {task} || {nl} AS serving_prompt, {head} || {task} AS training_prompt FROM sent"),
        "encode_response": _with(CLEAN, "SELECT sent_id, response FROM clean"),
        "encode_full_text": _with(CLEAN, f"SELECT sent_id, md5({head} || {task} || {nl} || {nl} || response || '<eos>') AS text_md5 FROM clean"),
        "format_efficiency": _with(TOK, f"SELECT sent_id, CAST(length(o) AS INTEGER) AS n_old, CAST(length(w) AS INTEGER) AS n_new, round(100 * (length(o) - length(w)) / nullif(length(o), 0), 1) AS saved_percent FROM (SELECT sent.sent_id, {aggregated(old)} AS o, {aggregated(new)} AS w FROM sent LEFT JOIN tok ON tok.sent_id = sent.sent_id GROUP BY sent.sent_id)"),
        "decode_tokens": _with(DEC, f"SELECT {flat} FROM dec WHERE sent_id NOT IN (SELECT sent_id FROM bad)"),
        "decode_errors": _with(DEC, "SELECT sent_id, error FROM bad"),
        "decode_lenient": _with(lenient, f"SELECT sent_id, row_number() OVER (PARTITION BY sent_id ORDER BY place) AS place, {lenient_cols} FROM f2"),
        "head_parse": _with(SENT, "SELECT sent_id, raw, CASE WHEN regexp_matches(raw, '^[+-]?[0-9]+$') THEN coalesce(try_cast(raw AS INTEGER), -1) ELSE -1 END AS head FROM (SELECT sent_id, (['', '+', '-', ' ', 'x', '0000', '9'])[sent_id % 7 + 1] || (sent_id * 7919) AS raw FROM sent)"),
        "reconstruct_text": _with(TOK, f"SELECT s.sent_id, md5({tok_md5}) AS text_md5, {tok_md5} = any_value(s.sentence) AS same FROM sent s LEFT JOIN tok t ON t.sent_id = s.sent_id GROUP BY s.sent_id"),
        "repair_status": _with(REP, "SELECT sent_id, repair, CAST(CASE WHEN repair IN ('drop_last', 'drop_last_trim') THEN n - 1 ELSE n END AS BIGINT) AS n_tokens, repair = 'normalize' AND beyond <> '' AS slipped, md5(CASE repair WHEN 'failed' THEN whole WHEN 'normalize' THEN sentence || beyond ELSE sentence END) AS text_md5 FROM state"),
        "analyze_replay": _with(REP, "SELECT sent_id, CASE WHEN error IS NOT NULL THEN error WHEN repair = 'failed' THEN 'Reconstructed text does not match the original sentence' END AS error, CAST(CASE WHEN repair IN ('drop_last', 'drop_last_trim') THEN n - 1 ELSE n END AS BIGINT) AS n_tokens FROM state"),
        "pattern_count": f"SELECT CAST({len(PATTERNS)} AS BIGINT) AS n",
        "match_format": _with(TOK + _pattern_sql(), "SELECT CAST(pattern_index AS INTEGER) AS pattern_index, 'Match { ' || array_to_string(pattern, ', ') || ' }' AS shown FROM pat"),
        "match_counts_by_label": _with(_match_sql("lemma"), "SELECT matched_label, count(*) AS n, count(DISTINCT sent_id) AS n_sentences FROM hits GROUP BY matched_label"),
        "tree_roots": _with(TOK, "SELECT s.sent_id, CAST(min(CASE WHEN dep = 'root' OR head = idx THEN idx END) AS INTEGER) AS root, CASE WHEN count(*) FILTER (dep = 'root' OR head = idx) = 0 THEN 'No root token found in tokenization' END AS error FROM sent s LEFT JOIN tok t ON t.sent_id = s.sent_id GROUP BY s.sent_id"),
        "tree_edges": _with(TOK + WALK, "SELECT sent_id, node, parent, dep, CAST(depth AS INTEGER) AS depth, path, terminal FROM walk", True),
        "tree_depths": _with(TOK + WALK, "SELECT sent_id, CAST(max(depth) AS INTEGER) AS depth, count(*) AS n_nodes FROM walk GROUP BY sent_id", True),
        "dep_match": _with(_dep_sql(), "SELECT sent_id, node, pattern_index, matched_label FROM deps", True),
        "dep_find_multiple": _with(_dep_sql(), "SELECT sent_id, pattern_index, matched_label, count(*) AS n_nodes, string_agg(CAST(node AS VARCHAR), ' ' ORDER BY node, path) AS nodes FROM deps GROUP BY ALL", True),
        "dep_contains": _with(_dep_sql(), "SELECT DISTINCT sent_id FROM deps WHERE pattern_index IN (2, 4)", True),
        "dep_match_groups": _with(_dep_sql(), "SELECT pattern_index, matched_label, count(*) AS n_nodes, count(DISTINCT sent_id) AS n_sentences FROM deps GROUP BY ALL", True),
        "corpus_process": _with(CLEAN, f"SELECT s.sent_id, any_value({_NAMES.replace('language', 's.language')}) AS language_name, " + ", ".join(f"md5(coalesce(string_agg({c}, '|' ORDER BY idx), '')) AS {n}" for n, c in moved_lists.items()) + " FROM sent s LEFT JOIN moved m ON m.sent_id = s.sent_id GROUP BY s.sent_id"),
        "punct_filter": _with(SENT, f"SELECT sent_id, {_ENDS} AS ends FROM sent"),
        "corpus_groups": _with(SENT + GROUPS, "SELECT sent_id, shard, rank, group_start FROM member", True),
        "corpus_split": _with(SENT + GROUPS, "SELECT sent_id, number, split FROM splits", True),
        "split_counts": _with(SENT + GROUPS, "SELECT split, count(DISTINCT number) AS n_groups, count(*) AS n_sentences FROM splits GROUP BY split", True),
        "corpus_prompt_pairs": _with(grouped, f"SELECT number, split, n_sentences, language, md5({head} || {task}) AS prompt_md5, md5('Here''s the token analysis:' || {nl} || {nl} || body || {nl} || {nl} || '</analysis>') AS response_md5 FROM grp", True),
        "eval_overall": _with(PRED, f"SELECT {accuracy}, count(*) AS total_tokens FROM pair"),
        "eval_by_language": _with(PRED, f"SELECT language, {correct}, {accuracy}, count(*) AS total_tokens FROM pair GROUP BY language"),
        "eval_confusion": _with(PRED, 'SELECT true_pos AS "true", pred_pos AS pred, count(*) AS n FROM pair GROUP BY ALL'),
        "eval_report": _with(report, "SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM rep"),
        "eval_report_dep": _with(report.replace("true_pos AS t, pred_pos AS p", "true_dep AS t, pred_dep AS p").replace("<= 20", "<= 4").replace("LIMIT 20", "LIMIT 4"), "SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM rep"),
        "eval_decoded": _with(REP, "SELECT " + ", ".join(f"round(count(*) FILTER (t.{x} = d.{x}) / count(*), 9) AS {x}_accuracy" for x in evaluate.LABELS) + ", count(*) AS total_tokens FROM tok t JOIN dec d USING (sent_id, idx) JOIN state s USING (sent_id) WHERE s.repair <> 'failed' AND NOT (s.repair IN ('drop_last', 'drop_last_trim') AND d.idx = s.n)"),
        "error_details": _with(REP, "SELECT sent_id, md5(whole) AS reconstructed_md5, md5(s.sentence) AS sentence_md5, md5(response) AS response_md5 FROM state s JOIN resp USING (sent_id) WHERE repair = 'failed' AND error IS NULL"),
        "texts_and_lemmas": _with(TOK, "SELECT s.sent_id, md5(coalesce(string_agg(text, ' ' ORDER BY idx), '')) AS texts_md5, md5(coalesce(string_agg(lemma, ' ' ORDER BY idx), '')) AS lemmas_md5, count(idx) AS n_tokens FROM sent s LEFT JOIN tok t ON t.sent_id = s.sent_id GROUP BY s.sent_id"),
        "analysis_extraction": _with(RESP, f"SELECT sent_id, md5({_trim('response', STRIP)}) AS analysis_md5 FROM resp"),
        "empty_pattern_match": _with(_match_sql("text"), """SELECT sent_id, CAST(CASE matched_label WHEN 'of_the' THEN 1 ELSE 2 END AS INTEGER) AS pattern_index, start, "end", matched_label FROM hits WHERE matched_label IN ('of_the', 'the')
UNION ALL SELECT sent_id, 0, CAST(idx AS INTEGER), CAST(idx AS INTEGER), 'none' FROM tok WHERE text NOT IN ('of', 'the')"""),
        "corpus_scan": _with(TOK, """SELECT language, md5(sentence) AS sentence_md5, n_tokens, lemmas_md5, count(*) AS n FROM (
  SELECT s.sent_id, any_value(s.language) AS language, any_value(s.sentence) AS sentence, count(idx) AS n_tokens, md5(coalesce(string_agg(lemma, ' ' ORDER BY idx), '')) AS lemmas_md5 FROM sent s LEFT JOIN tok t ON t.sent_id = s.sent_id GROUP BY s.sent_id
) GROUP BY ALL"""),
        "eos_check": _with(SENT + GROUPS, "SELECT split, count(DISTINCT number) AS n, CAST(0 AS BIGINT) AS n_lacking FROM splits GROUP BY split", True),
        "format_per_item": _with(TOK, f"SELECT sent_id, round(length(o) / nullif(n, 0), 1) AS old_per_item, round(length(w) / nullif(n, 0), 1) AS new_per_item, round(length(o) / nullif(n, 0) * 10, 0) AS old_of_ten, round(length(w) / nullif(n, 0) * 10, 0) AS new_of_ten FROM (SELECT sent.sent_id, count(idx) AS n, {aggregated(old)} AS o, {aggregated(new)} AS w FROM sent LEFT JOIN tok ON tok.sent_id = sent.sent_id GROUP BY sent.sent_id)"),
        "pos_dep_domain_check": _with(TOK, f"SELECT pos, dep, count(*) AS n, bool_and(pos IN ({_quoted(POS)}) AND dep IN ({_quoted(DEP)})) AS known FROM tok GROUP BY pos, dep"),
        "limit_per_language": _with(SENT, "SELECT language, sent_id FROM sent QUALIFY row_number() OVER (PARTITION BY language ORDER BY sent_id) <= 50"),
        "latest_checkpoint": "SELECT 'run/checkpoint-' || max(doc_id) AS path, max(doc_id) AS step FROM documents WHERE doc_id % 3 = 0",
        "json_round_trip": _with(TOK, "SELECT s.sent_id, " + ", ".join(f"md5(coalesce(string_agg(CAST({c} AS VARCHAR), ' ' ORDER BY idx), '')) AS {c}_md5" for c in ("text", "whitespace", "pos", "lemma", "dep", "head")) + " FROM sent s LEFT JOIN tok t ON t.sent_id = s.sent_id GROUP BY s.sent_id"),
        "grammar_check": "WITH " + _grammar_sql().strip(),
        "token_budget": _with(SENT, f"SELECT sent_id, {budget} AS max_tokens FROM sent"),
    }
    for key in ("text", "lemma"):
        out[f"{key}_match"] = _with(_match_sql(key), "SELECT * FROM hits")
        out[f"{key}_contains"] = _with(_match_sql(key), "SELECT DISTINCT sent_id FROM hits WHERE pattern_index IN (0, 3, 6)")
    return out

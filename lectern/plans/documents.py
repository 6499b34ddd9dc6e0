"""Queries over documents, pages, benchmark and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import merge, scoring

AS_OF = 2025
NORM = "trim(regexp_replace(regexp_replace(replace(lower(strip_accents({})), 'ß', 'ss'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
_STOPPED = ", ".join(f"'{w}'" for w in [*X.CLAUSE_WORDS, *X.STOP_WORDS])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phrases_sql(text: str, sizes: tuple[int, ...]) -> str:
    """The same n-grams as functions.text.phrases, as a DuckDB expression over lists."""
    words = f"regexp_extract_all(lower({text}), '[A-Za-z][A-Za-z-]+')"
    marked = f"list_transform({words}, lambda w: CASE WHEN w IN ({_STOPPED}) THEN '|' ELSE w END)"
    runs = f"list_filter(list_transform(string_split(array_to_string({marked}, ' '), '|'), lambda r: trim(r)), lambda r: r <> '')"
    split = f"list_transform({runs}, lambda r: string_split(r, ' '))"
    grams = [f"flatten(list_transform({split}, lambda o: list_transform(range(1, greatest(len(o) - {n - 2}, 1)), lambda i: array_to_string(o[i:i + {n - 1}], ' '))))" for n in sizes]
    return "list_concat(" + ", ".join([*grams, "[]"]) + ")"


def norm_key_docs(spark, sf_dir):
    key = X.norm_title("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(key).alias("key_md5"), F.length(key).alias("key_length"))


NORM_KEY_DOCS = f"SELECT doc_id, md5(k) AS key_md5, CAST(length(k) AS INTEGER) AS key_length FROM (SELECT doc_id, {NORM.format('text')} AS k FROM documents)"


def dedupe_by_key(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    sources = [docs.where(docs["lang"] == lang) for lang in ("en", "de", "fr", "es")]
    sources = [s.select(F.md5(X.norm_title("text")).alias("key_md5"), F.col("doc_id").alias("seq"), "source") for s in sources]
    bench = read(spark, sf_dir, "benchmark").select(F.md5(X.norm_title("text")).alias("key_md5"), F.col("item_id").alias("seq"))
    return merge.union_first([*sources, bench], "key_md5", "seq")


DEDUPE_BY_KEY = f"""
WITH u AS (
  SELECT md5({NORM.format('text')}) AS key_md5, doc_id AS seq, source, list_position(['en', 'de', 'fr', 'es'], lang) - 1 AS engine FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')
  UNION ALL SELECT md5({NORM.format('text')}), item_id, NULL, 4 FROM benchmark)
SELECT key_md5, seq, source, CAST(engine AS INTEGER) AS engine FROM (SELECT *, row_number() OVER (PARTITION BY key_md5 ORDER BY engine, seq) AS n FROM u) WHERE n = 1
"""


def keyed_upsert(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    hits = docs.select(
        F.md5(X.norm_title("text")).alias("key"),
        "doc_id", "lang", "source",
        F.when(F.col("lang") != "fr", F.col("n_chars")).alias("cites"),
        F.concat_ws(":", "lang", "source").alias("path"),
        F.array("source", "lang").alias("refs"),
    )
    out = merge.keyed_upsert(hits, "key", "doc_id", ["doc_id", "lang", "source"], "cites", "path", "refs", excluding=F.col("source") == "src3")
    return out.select("key", "doc_id", "lang", "source", "cites", F.array_join("refs", ",").alias("refs"), F.array_join("paths", ",").alias("paths"))


KEYED_UPSERT = f"""
WITH h AS (SELECT md5({NORM.format('text')}) AS key, doc_id, lang, source, CASE WHEN lang <> 'fr' THEN n_chars END AS cites, lang || ':' || source AS path FROM documents),
k AS (SELECT * FROM h WHERE key NOT IN (SELECT key FROM h WHERE source = 'src3')),
a AS (SELECT key, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source, max(cites) AS cites FROM k GROUP BY key),
r AS (SELECT key, string_agg(v, ',' ORDER BY v) AS refs FROM (SELECT DISTINCT key, unnest([source, lang]) AS v FROM k) GROUP BY key),
p AS (SELECT key, string_agg(path, ',' ORDER BY s) AS paths FROM (SELECT key, path, min(doc_id) AS s FROM k GROUP BY key, path) GROUP BY key)
SELECT key, doc_id, lang, source, cites, refs, paths FROM a JOIN r USING (key) JOIN p USING (key)
"""


def source_union_except(spark, sf_dir):
    keyed = read(spark, sf_dir, "documents").select("source", "lang", F.md5(X.norm_title("text")).alias("key"))
    parts = [keyed.where(F.col("lang") == lang).select("source", "key") for lang in ("en", "de", "fr")]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    cited = keyed.where(F.col("source").isin("src0", "src1")).select("key").distinct()
    left = found.join(cited, "key", "left_anti").groupBy("source").agg(F.count_distinct("key").alias("n_new"))
    seeds = keyed.select("source").distinct()
    return seeds.join(left, "source", "left").select("source", F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new"), F.col("n_new").isNull().alias("empty_seed"))


SOURCE_UNION_EXCEPT = f"""
WITH k AS (SELECT source, lang, md5({NORM.format('text')}) AS key FROM documents),
l AS (SELECT source, count(DISTINCT key) AS n FROM k WHERE lang IN ('en', 'de', 'fr') AND key NOT IN (SELECT key FROM k WHERE source IN ('src0', 'src1')) GROUP BY source)
SELECT s.source, coalesce(l.n, 0) AS n_new, l.n IS NULL AS empty_seed FROM (SELECT DISTINCT source FROM k) s LEFT JOIN l USING (source)
"""


def documents_less_benchmark(spark, sf_dir):
    """New keys of each source: those of all its documents, whatever their language, that no benchmark passage has."""
    keyed = read(spark, sf_dir, "documents").select("source", F.md5(X.norm_title("text")).alias("key"))
    known = read(spark, sf_dir, "benchmark").select(F.md5(X.norm_title("text")).alias("key")).distinct()
    left = keyed.join(known, "key", "left_anti").groupBy("source").agg(F.count_distinct("key").alias("n_new")).where("n_new > 0")
    seeds = keyed.select("source").distinct()
    found = seeds.join(left, seeds["source"].eqNullSafe(left["source"]), "left")
    return found.select(seeds["source"], F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new"), F.col("n_new").isNull().alias("empty_seed"))


DOCUMENTS_LESS_BENCHMARK = f"""
WITH k AS (SELECT source, md5({NORM.format('text')}) AS key FROM documents),
b AS (SELECT md5({NORM.format('text')}) AS key FROM benchmark),
l AS (SELECT source, count(DISTINCT key) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.key = k.key) GROUP BY source HAVING count(DISTINCT key) > 0)
SELECT s.source, coalesce(l.n, 0) AS n_new, l.n IS NULL AS empty_seed FROM (SELECT DISTINCT source FROM k) s LEFT JOIN l ON s.source IS NOT DISTINCT FROM l.source
"""


def engines_upsert(spark, sf_dir):
    """Keyed upsert of documents, pages and benchmark as three engines in this order."""
    docs, pages, bench = (read(spark, sf_dir, t) for t in ("documents", "pages", "benchmark"))

    def hits(rows: DataFrame, engine: int, path: str, text: str, own: str, cites: Column, refs: Column) -> DataFrame:
        return rows.select(
            F.md5(X.norm_title(text)).alias("key"), F.struct(F.lit(engine).alias("engine"), F.col(own).alias("id")).alias("seq"),
            F.lit(path).alias("path"), F.col(own).alias("id"), cites.cast("long").alias("cites"), refs.alias("refs"),
        )

    none = F.array().cast("array<string>")
    found = hits(docs, 0, "documents", "text", "doc_id", F.col("n_chars"), F.array("source", "lang"))
    found = found.unionByName(hits(pages, 1, "pages", "html", "page_id", F.lit(None), F.array("url")))
    found = found.unionByName(hits(bench, 2, "benchmark", "text", "item_id", F.lit(None), none))
    out = merge.keyed_upsert(found.withColumn("engine", F.col("path")), "key", "seq", ["engine", "id"], "cites", "path", "refs")
    return out.select("key", "engine", "id", "cites", F.array_join("refs", ",").alias("refs"), F.array_join("paths", ",").alias("paths"))


ENGINES_UPSERT = f"""
WITH h AS (
  SELECT md5({NORM.format('text')}) AS key, 0 AS e, 'documents' AS engine, doc_id AS id, n_chars AS cites, [source, lang] AS refs FROM documents
  UNION ALL SELECT md5({NORM.format('html')}), 1, 'pages', page_id, NULL, [url] FROM pages
  UNION ALL SELECT md5({NORM.format('text')}), 2, 'benchmark', item_id, NULL, [] FROM benchmark),
a AS (SELECT key, engine, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY e, id) AS n FROM h WHERE key IS NOT NULL) WHERE n = 1),
c AS (SELECT key, max(cites) AS cites FROM h GROUP BY key),
r AS (SELECT key, string_agg(v, ',' ORDER BY v) AS refs FROM (SELECT DISTINCT key, unnest(refs) AS v FROM h) GROUP BY key),
p AS (SELECT key, string_agg(engine, ',' ORDER BY e) AS paths FROM (SELECT DISTINCT key, e, engine FROM h) GROUP BY key)
SELECT key, engine, id, cites, coalesce(refs, '') AS refs, paths FROM a JOIN c USING (key) LEFT JOIN r USING (key) JOIN p USING (key)
"""


def median_impute_score(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    known = docs.join(labels, "doc_id", "left").withColumn("cites", F.when(F.col("quality").isNotNull(), F.col("n_chars")))
    full = merge.impute_median(known, "cites", "imputed")
    year = (AS_OF - F.col("doc_id") % 12).cast("int")
    return full.select("doc_id", "imputed", F.round(scoring.score(F.lit(0), F.lit(1), F.col("imputed"), year, AS_OF), 6).alias("score"))


MEDIAN_IMPUTE_SCORE = f"""
WITH j AS (SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN d.n_chars END AS cites, {AS_OF} - d.doc_id % 12 AS y FROM documents d LEFT JOIN labels l USING (doc_id)),
m AS (SELECT coalesce(median(cites), 0.0) AS med FROM j)
SELECT doc_id, coalesce(CAST(cites AS DOUBLE), med) AS imputed,
  round(1 + 0.2 * log10(1 + coalesce(CAST(cites AS DOUBLE), med) / greatest(1, {AS_OF} - y + 1)) + CASE WHEN y >= {AS_OF} - 3 THEN 0.5 ELSE 0 END, 6) AS score
FROM j, m
"""


def _angles(docs: DataFrame) -> DataFrame:
    """The 20 most frequent 2- and 3-word phrases of the first English document, of equals the earlier, as one row's array."""
    seed = docs.where("lang = 'en'").orderBy("doc_id").limit(1)
    each = seed.select(F.posexplode(X.phrases("text", (3, 2))).alias("pos", "phrase"))
    top = each.groupBy("phrase").agg(F.count("*").alias("n"), F.min("pos").alias("first")).orderBy(F.desc("n"), "first").limit(20)
    return top.agg(F.array_sort(F.collect_list("phrase")).alias("angles"))


def _graded(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("labelled"))
    angles = F.broadcast(_angles(docs))  # one row of 20 phrases
    # each title meets the angles where it is read, so that only its key and numbers are shuffled
    titled = docs.select("doc_id", "n_chars", X.norm_title("text").alias("title")).crossJoin(angles)
    titled = titled.select(F.md5("title").alias("key"), "doc_id", "n_chars", scoring.overlap(F.col("title"), F.col("angles")).alias("shared"))
    first = titled.groupBy("key").agg(F.min_by(F.struct("doc_id", "n_chars", "shared"), "doc_id").alias("f")).select("f.*")
    t = first.join(labels, "doc_id", "left")
    shared, paths = F.col("shared"), (1 + F.coalesce("labelled", F.lit(0))).cast("int")
    year = (AS_OF - F.col("doc_id") % 12).cast("int")
    return t.select(
        "doc_id",
        shared.alias("overlap"),
        paths.alias("paths"),
        F.round(scoring.score(shared, paths, F.col("n_chars").cast("double"), year, AS_OF), 4).alias("score"),
        scoring.grade(shared, paths).alias("grade"),
    )


def ranked_sweep(spark, sf_dir):
    """Title keys, first-wins dedupe, phrases of a seed as angles, score, grade, order."""
    return scoring.ranked(_graded(spark, sf_dir), title="doc_id")


_GRADED = f"""
WITH docs AS (SELECT *, {NORM.format('text')} AS title FROM documents),
seed AS (SELECT {phrases_sql('text', (3, 2))} AS ps FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 1),
each AS (SELECT unnest(ps) AS phrase, unnest(range(len(ps))) AS pos FROM seed),
top AS (SELECT phrase FROM (SELECT phrase, count(*) AS n, min(pos) AS first FROM each GROUP BY phrase) ORDER BY n DESC, first LIMIT 20),
angles AS (SELECT list(phrase) AS angles FROM top),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY md5(title) ORDER BY doc_id) AS k FROM docs) WHERE k = 1),
lab AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id),
f AS (SELECT d.doc_id, d.n_chars, {AS_OF} - d.doc_id % 12 AS y, CAST(CASE WHEN d.title = '' THEN 0 ELSE len(list_filter(a.angles, lambda x: contains(d.title, x))) END AS INTEGER) AS overlap,
  CAST(1 + coalesce(lab.n, 0) AS INTEGER) AS paths FROM firsts d LEFT JOIN lab USING (doc_id), angles a),
g AS (SELECT doc_id, overlap, paths,
  round(2.0 * overlap + paths + 0.2 * log10(1 + CAST(n_chars AS DOUBLE) / greatest(1, {AS_OF} - y + 1)) + CASE WHEN y >= {AS_OF} - 3 THEN 0.5 ELSE 0 END, 4) AS score,
  CASE WHEN overlap > 0 AND paths >= 2 THEN 'THREAT' WHEN overlap > 0 OR paths >= 2 THEN 'RELATED' ELSE 'BACKGROUND' END AS grade FROM f)
"""
RANKED_SWEEP = _GRADED + "SELECT * FROM g"


def grade_ladder(spark, sf_dir):
    g = _graded(spark, sf_dir)
    return g.groupBy("grade").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min("doc_id").alias("first_doc"))


GRADE_LADDER = _GRADED + "SELECT grade, count(*) AS n, max(score) AS best, min(doc_id) AS first_doc FROM g GROUP BY grade"


def ngram_phrases(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("lang = 'en'")
    each = docs.select("doc_id", F.explode(X.phrases("text", (3, 2))).alias("phrase"))
    return each.groupBy("phrase").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n >= 3")


NGRAM_PHRASES = f"""
SELECT phrase, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest({phrases_sql('text', (3, 2))}) AS phrase FROM documents WHERE lang = 'en')
GROUP BY phrase HAVING count(*) >= 3
"""

_AXES = {"licence": ("[Ll]icen[cs]", "GNU"), "contact": ("@", "[0-9]{3}-[0-9]{4}"), "scale": ("[0-9]{4}", "[0-9]")}


def sentence_first_match(spark, sf_dir):
    """First sentence for each document and axis, by order of pattern, then of sentence."""
    s = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences("text")).alias("ord", "sentence"))
    hits = None
    for axis, patterns in _AXES.items():
        found = F.coalesce(*[F.when(F.col("sentence").rlike(p), k) for k, p in enumerate(patterns)])
        own = s.select("doc_id", F.lit(axis).alias("axis"), found.alias("pattern"), "ord", "sentence").where("pattern is not null")
        hits = own if hits is None else hits.unionByName(own)
    best = hits.groupBy("doc_id", "axis").agg(F.min_by(F.struct("pattern", "ord", F.md5("sentence").alias("sentence_md5")), F.struct("pattern", "ord")).alias("b"))
    return best.select("doc_id", "axis", "b.*")


SENTENCE_FIRST_MATCH = f"""
WITH s AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS ord FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents)),
h AS ({" UNION ALL ".join(f"SELECT doc_id, '{a}' AS axis, CASE WHEN regexp_matches(sentence, '{p[0]}') THEN 0 WHEN regexp_matches(sentence, '{p[1]}') THEN 1 END AS pattern, ord, sentence FROM s" for a, p in _AXES.items())})
SELECT doc_id, axis, CAST(pattern AS INTEGER) AS pattern, CAST(ord AS INTEGER) AS ord, md5(sentence) AS sentence_md5
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, axis ORDER BY pattern, ord) AS n FROM h WHERE pattern IS NOT NULL) WHERE n = 1
"""


def parse_count(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit("[0-9][0-9,.]*[0-9] ?(?:million|thousand|K|M)?"), F.lit(0))
    tokens = read(spark, sf_dir, "documents").select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return tokens.select("token", "n", X.parse_count("token").alias("parsed"))


PARSE_COUNT = """
WITH t AS (SELECT unnest(regexp_extract_all(text, '[0-9][0-9,.]*[0-9] ?(?:million|thousand|K|M)?')) AS token FROM documents),
g AS (SELECT token, count(*) AS n, lower(trim(token)) AS s FROM t GROUP BY token)
SELECT token, n, TRY_CAST(trunc(TRY_CAST(replace(regexp_extract(s, '^[0-9,.]+'), ',', '') AS DOUBLE)
  * CASE regexp_extract(s, '[a-z]+$') WHEN 'million' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'thousand' THEN 1e3 WHEN 'k' THEN 1e3 ELSE 1 END) AS BIGINT) AS parsed FROM g
"""


def coverage_histogram(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    words = F.size(F.split(F.trim("text"), r"\s+"))
    return d.groupBy("lang", "source").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("text").rlike("[0-9]")).alias("with_digits"),
        F.count_if(words <= 50).alias("short"),
        F.round(100.0 * F.avg((F.length("text") == F.col("n_chars")).cast("double")), 2).alias("pct_consistent"),
    )


COVERAGE_HISTOGRAM = r"""
SELECT lang, source, count(*) AS n, count(*) FILTER (regexp_matches(text, '[0-9]')) AS with_digits,
  count(*) FILTER (len(string_split_regex(trim(text), '\s+')) <= 50) AS short,
  round(100.0 * avg(CASE WHEN length(text) = n_chars THEN 1.0 ELSE 0.0 END), 2) AS pct_consistent
FROM documents GROUP BY lang, source
"""


def verdict_ladder(spark, sf_dir):
    """Quality and toxic labels as two engines' outcomes on a document."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    steps = docs.select(F.col("doc_id").alias("step_id"), F.when(F.col("source") == "src7", "structural").otherwise("display").alias("kind"), (F.col("lang") == "en").alias("domains_known"))
    a = labels.select(F.col("doc_id").alias("step_id"), F.lit("rational").alias("engine"), F.when(F.col("toxic") == 1, "refuted").otherwise("not-refuted").alias("outcome"), F.when(F.col("doc_id") % 5 == 0, "partial").alias("translation_confidence"))
    b = labels.select(F.col("doc_id").alias("step_id"), F.lit("symbolic").alias("engine"), F.when(F.col("quality") == 1, "confirmed").otherwise("error").alias("outcome"), F.lit(None).cast("string").alias("translation_confidence"))
    return scoring.compose_verdicts(steps, a.unionByName(b)).groupBy("severity").agg(F.count("*").alias("n"), F.count_if("confirmed").alias("n_confirmed"), F.min("step_id").alias("first_step"))


VERDICT_LADDER = """
WITH f AS (SELECT doc_id, bool_or(toxic = 1) AS r, bool_or(quality = 1) AS c, bool_or(toxic <> 1) AS nr FROM labels GROUP BY doc_id),
v AS (SELECT d.doc_id, d.source = 'src7' AS st, coalesce(f.r, FALSE) AS r, coalesce(f.c, FALSE) AS c, d.lang = 'en' AS known, f.doc_id IS NULL OR d.doc_id % 5 <> 0 AS fa, coalesce(f.nr, FALSE) AS nr
  FROM documents d LEFT JOIN f USING (doc_id)),
s AS (SELECT doc_id, CASE WHEN st THEN 'SKIP' WHEN r AND c THEN 'UNVERIFIED' WHEN r AND NOT known AND NOT fa THEN 'UNVERIFIED' WHEN r AND NOT known THEN 'MAJOR' WHEN r AND NOT fa THEN 'WEAK' WHEN r THEN 'CRITICAL'
  WHEN c AND NOT fa THEN 'WEAK' WHEN c THEN 'SKIP' WHEN nr THEN 'WEAK' ELSE 'UNVERIFIED' END AS severity, c AND NOT r AND fa AND NOT st AS confirmed FROM v)
SELECT severity, count(*) AS n, count(*) FILTER (confirmed) AS n_confirmed, min(doc_id) AS first_step FROM s GROUP BY severity
"""


def wilson_rule3(spark, sf_dir):
    j = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    g = j.groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    w = scoring.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "n", "k", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"), F.round(scoring.rule_of_three(F.col("n")), 6).alias("rule3"), F.round(scoring.no_failures(F.lit(0.01), F.col("n")), 6).alias("none_at_1pct"))


WILSON_RULE3 = """
WITH g AS (SELECT lang, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang),
p AS (SELECT *, k / CAST(n AS DOUBLE) AS p, 1.96 * 1.96 AS zz FROM g)
SELECT lang, n, k, round((p + zz / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n))) / (1 + zz / n), 6) AS low,
  round((p + zz / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n))) / (1 + zz / n), 6) AS high, round(3.0 / n, 6) AS rule3, round(pow(0.99, n), 6) AS none_at_1pct FROM p
"""


def content_hash_groups(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.groupBy(X.content_hash("lang", "text").alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("sources")).where("n > 1").drop("h")


CONTENT_HASH_GROUPS = r"""
SELECT count(*) AS n, min(doc_id) AS first_doc, count(DISTINCT source) AS sources FROM documents GROUP BY lang, trim(regexp_replace(text, '\s+', ' ', 'g')) HAVING count(*) > 1
"""


def markup_filter(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "text")
    p = read(spark, sf_dir, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    both = d.unionByName(p).select("kind", "id", F.posexplode(X.sentences("text")).alias("ord", "s"))
    return both.groupBy("kind").agg(F.count("*").alias("sentences"), F.count_if(X.is_markup("s")).alias("markup"))


MARKUP_FILTER = """
WITH t AS (SELECT 'documents' AS kind, text FROM documents UNION ALL SELECT 'pages', html FROM pages),
s AS (SELECT kind, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS s FROM t)
SELECT kind, count(*) AS sentences, count(*) FILTER (length(s) - length(translate(s, '\\{}$&', '')) > greatest(4.0, length(s) / 12.0)) AS markup FROM s GROUP BY kind
"""


def doi_route(spark, sf_dir):
    """Route of each page's URL: by number, by host, else by title key."""
    url = F.col("url")
    host = F.lower(F.regexp_extract(url, "^[a-z]+://([^/]+)", 1))
    route = F.when(url.rlike(r"/10\.[0-9]{4,}/"), "doi").when(url.rlike("[0-9]{4}[.][0-9]{4,5}"), "arxiv").when(url.rlike("/[0-9]+$"), "numbered").otherwise("title")
    return read(spark, sf_dir, "pages").groupBy(route.alias("route"), host.alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


DOI_ROUTE = r"""
SELECT CASE WHEN regexp_matches(url, '/10\.[0-9]{4,}/') THEN 'doi' WHEN regexp_matches(url, '[0-9]{4}[.][0-9]{4,5}') THEN 'arxiv' WHEN regexp_matches(url, '/[0-9]+$') THEN 'numbered' ELSE 'title' END AS route,
  lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1, 2
"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (ranked_sweep, RANKED_SWEEP), (norm_key_docs, NORM_KEY_DOCS), (dedupe_by_key, DEDUPE_BY_KEY), (keyed_upsert, KEYED_UPSERT),
        (source_union_except, SOURCE_UNION_EXCEPT), (documents_less_benchmark, DOCUMENTS_LESS_BENCHMARK), (engines_upsert, ENGINES_UPSERT), (median_impute_score, MEDIAN_IMPUTE_SCORE), (grade_ladder, GRADE_LADDER), (ngram_phrases, NGRAM_PHRASES),
        (sentence_first_match, SENTENCE_FIRST_MATCH), (parse_count, PARSE_COUNT), (coverage_histogram, COVERAGE_HISTOGRAM), (verdict_ladder, VERDICT_LADDER),
        (wilson_rule3, WILSON_RULE3), (content_hash_groups, CONTENT_HASH_GROUPS),
        (markup_filter, MARKUP_FILTER), (doi_route, DOI_ROUTE),
    )
}

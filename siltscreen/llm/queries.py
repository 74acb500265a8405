"""One query per operator over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query
def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded; digests of the ids and of the decoded text."""
    from siltscreen.llm import bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoder = bpe.make_encoder(docs, tokenizer_path())
    done = bpe.decode(bpe.encode(docs, encoder), encoder, packed="packed")
    return done.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurring benchmark windows, and the items they come from."""
    from siltscreen.llm import decontaminate as d

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = d.leaks(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    items = F.array_sort(F.array_distinct("hit_items"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document by a classifier that never saw the held-out labels."""
    from siltscreen.llm import toxicity as t

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = t.score(docs, t.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        t.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "threshold",
        "toxic",
    )


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors by cosine, whatever their labels."""
    from siltscreen.llm import vectors as v

    return v.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near copies (five words, 0.8) and its number of links."""
    from siltscreen.llm import jaccard

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_documents(docs).drop("text")


@query
def op6_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in rows of 2048, with segment ends and positions."""
    from siltscreen.llm import bpe, packing

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, bpe.vocabulary_encoder(spark, tokenizer_path()))


def planned_edits() -> Column:
    """Three edits of a document at places that follow from its id: a replacement, a deletion and an insertion of its own words."""
    size = F.coalesce(F.length("text"), F.lit(0))
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), (size + 1).cast("bigint")).cast("int")
    cut = lambda k: F.coalesce(F.substr("text", place(k) + 1, F.lit(24)), F.lit(""))
    change = lambda start, n, new: F.struct(start.alias("start"), (start + n).alias("stop"), new.alias("text"))
    return F.array(change(place(1), 12, cut(4)), change(place(2), 9, F.lit("")), change(place(3), 0, cut(5)))


@query
def op8_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each, by segment trees."""
    from siltscreen.llm import bpe, edits

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoder = bpe.make_encoder(docs, tokenizer_path())
    counted = edits.count_trees(docs.withColumn("edits", planned_edits()), encoder)
    before = counted.withColumn("n_tokens_before", F.col("n_tokens"))
    done = edits.apply_edits(before, encoder)
    return done.select("doc_id", "n_tokens_before", "n_tokens", "n_encoded", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text evidence, its site's shrunken prior, and the posterior of being good."""
    from siltscreen.llm import quality as q

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = q.train(docs, table(spark, sf_dir, "labels"))
    done = q.assess(docs, model, keep=["doc_id"])
    return done.select("doc_id", q.held_out(F.col("doc_id")).alias("held_out"), "evidence", "site_prior", "posterior", "good")


@query
def op10_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    from siltscreen.llm import sharding as s

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = s.shard(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def url_entries(pages: DataFrame, events: DataFrame) -> DataFrame:
    """A dated list from the tables: every event is an entry about the page whose number is its id modulo their count.

    Page ids are 0, 1, 2 and so on.  The event's type picks list and kind, every third event takes its entry off the list again.
    """
    from siltscreen.llm import urls as u

    url, kind = F.col("url"), F.col("event_type")
    labels = F.split(u.url_host(url), r"\.")
    top = F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), ".")
    first = F.concat(u.url_host(url), F.lit("/"), F.split(u.url_path(url), "/")[0])
    entry = lambda name, about, value: F.struct(F.lit(name).alias("list"), F.lit(about).alias("kind"), value.alias("value"))
    plan = F.when(kind == "click", entry("adverts", "host", u.url_host(url))).when(kind == "view", entry("spam", "domain", top))
    plan = plan.when(kind == "error", entry("malware", "url", u.whole_url(url))).otherwise(entry("abuse", "prefix", first))
    about = F.pmod(events["event_id"], F.lit(max(pages.count(), 1)))
    joined = events.join(pages, about == pages["page_id"])
    return joined.select(plan.alias("_e"), F.col("ts").alias("dated"), (F.col("event_id") % 3 != 0).alias("listed")).select("_e.*", "dated", "listed")


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list as it was when the page was fetched (a time that follows from its id)."""
    from siltscreen.llm import urls as u

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    when = F.timestamp_seconds(F.lit(1704067200) + (F.col("page_id") * 7919) % 2592000)
    done = u.listed_captures(pages.withColumn("fetched_at", when), url_entries(pages, table(spark, sf_dir, "events")))
    since = F.unix_micros("listed_since")
    return done.select("page_id", "url", F.unix_seconds("fetched_at").alias("fetched_at"), "n_entries", F.concat_ws(",", "lists").alias("lists"), since.alias("listed_since"), "blocked")


ORACLE["op3_url_filters"] = r"""
WITH parts AS (
  SELECT page_id, url, 1704067200 + (page_id * 7919) % 2592000 AS fetched_at,
         rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)', 1) AS path,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)', 1) AS rest
  FROM pages),
addr AS (SELECT *, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda s: s <> '') AS s FROM parts),
entry AS (
  SELECT CASE event_type WHEN 'click' THEN 'adverts' WHEN 'view' THEN 'spam' WHEN 'error' THEN 'malware' ELSE 'abuse' END AS list,
         CASE event_type WHEN 'click' THEN 'host' WHEN 'view' THEN 'domain' WHEN 'error' THEN 'url' ELSE 'prefix' END AS kind,
         CASE event_type WHEN 'click' THEN host WHEN 'view' THEN array_to_string(l[-2:], '.') WHEN 'error' THEN host || rest
              ELSE host || '/' || string_split(path, '/')[1] END AS value,
         epoch_us(ts) AS dated, bool_or(event_id % 3 <> 0) AS listed
  FROM events JOIN addr ON event_id % (SELECT count(*) FROM pages) = page_id GROUP BY 1, 2, 3, 4),
state AS (
  SELECT *, lead(dated) OVER (PARTITION BY list, kind, value ORDER BY dated) AS until,
         lag(listed, 1, false) OVER (PARTITION BY list, kind, value ORDER BY dated) AS was FROM entry),
island AS (SELECT *, sum(CASE WHEN listed <> was THEN 1 ELSE 0 END) OVER (PARTITION BY list, kind, value ORDER BY dated) AS k FROM state),
span AS (
  SELECT list, kind, value, min(dated) AS since, CASE WHEN count(*) = count(until) THEN max(until) END AS until
  FROM island WHERE listed GROUP BY list, kind, value, k),
key AS (
  SELECT page_id, fetched_at, 'url' AS kind, host || rest AS value FROM addr WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, 'host', host FROM addr WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, 'domain', array_to_string(l[-k:], '.') FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM addr WHERE host <> '')
  UNION ALL SELECT page_id, fetched_at, 'prefix', host || '/' || array_to_string(s[1:k], '/') FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM addr WHERE host <> '')),
hit AS (
  SELECT page_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, min(since) AS since
  FROM key JOIN span USING (kind, value)
  WHERE since <= fetched_at * 1000000 AND (until IS NULL OR fetched_at * 1000000 < until) GROUP BY page_id)
SELECT page_id, url, fetched_at, coalesce(n, 0) AS n_entries, coalesce(lists, '') AS lists, since AS listed_since, n IS NOT NULL AS blocked
FROM parts LEFT JOIN hit USING (page_id)
"""


# SQL for the operators that it can express: words, shingles and cosines; groups by recursion.

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
#: From `node(id)` and `link(x, y)` in both directions: the smallest id that each node reaches.
_REACHED = """
reach(root, node) AS (SELECT id, id FROM node UNION SELECT root, y FROM reach JOIN link ON node = x),
low AS (SELECT root AS id, min(node) AS low FROM reach GROUP BY root),
degree AS (SELECT x AS id, count(*) AS n FROM link GROUP BY x)
"""

ORACLE["op5_benchmark_decontamination"] = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM item WHERE len(w) > 0)),
place AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, k, n, item_id FROM place JOIN win USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLE["op4_jaccard_join"] = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM shared JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 10 * c >= 8 * (a.n + b.n - c)),
node AS (SELECT doc_id AS id FROM documents), {_REACHED}
SELECT id AS doc_id, coalesce(n, 0) AS n_links, low AS group_id, id = low AS kept FROM low LEFT JOIN degree USING (id)
"""

ORACLE["op2_embedding_near_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
node AS (SELECT vec_id AS id FROM embeddings), {_REACHED}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, low AS component_id, id = low AS kept FROM low LEFT JOIN degree USING (id)
"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each source's documents at each step of all 120 orders."""
    from siltscreen.llm import audit

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit.filter_audit(docs, table(spark, sf_dir, "labels"))


#: Walks every document through every order, filter by filter, without coalitions.
ORACLE["op13_filter_audit"] = r"""
WITH doc AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
low AS (SELECT t, min(doc_id) AS first FROM doc GROUP BY t),
mark AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS f
  FROM doc JOIN low USING (t) LEFT JOIN mark USING (doc_id)),
cell AS (SELECT part, f, good, toxic, count(*) AS n FROM failed GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
stage AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS past FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
walk AS (
  SELECT *, contains(f, x) AS bad, len(list_filter(string_split(past, ''), lambda p: p <> '' AND contains(f, p))) > 0 AS gone FROM stage, cell),
counted AS (
  SELECT part, filter_order, step, x, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND bad THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f = x THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND bad THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND bad THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM walk GROUP BY ALL),
share AS (SELECT part, x, sum(removed) AS shapley FROM counted GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley
FROM counted JOIN share USING (part, x)
"""


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    from siltscreen.llm import search

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.ranked(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE["op11_lexical_search"] = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
total AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM doc WHERE len(w) > 0),
asked AS (SELECT DISTINCT item_id, unnest(w) AS t FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
wanted AS (SELECT DISTINCT t FROM asked),
place AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM doc) JOIN wanted USING (t) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM place, total GROUP BY t, n_docs),
size AS (SELECT doc_id, (10 + (90 * len(w) * n_docs) // n_terms)::BIGINT AS m FROM doc, total WHERE len(w) > 0),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN place USING (t) JOIN weight USING (t) JOIN size USING (doc_id) GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
SELECT item_id, r::INT AS rank, doc_id, score FROM ranks WHERE r <= 10
"""


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest learned language of every document; far ones are marked, not renamed."""
    from siltscreen.llm import language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs)
    done = language.identify(docs, model, reject=False, keep=["doc_id"])
    return done.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")

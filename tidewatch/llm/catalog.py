"""The text operators as named queries over the benchmark tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    decontaminate, jaccard, language, licenses, lines, pieces, prefixes, quality, sharding, suffixes, token_store, urls, whitening,
)
from tidewatch.llm.common import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"
#: Spark's names for letters A-Z and a-z.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def joined(column: str) -> Column:
    """Distinct values in order, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(column)), ",")


def digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


@query
def op1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as pieces, and back."""
    found = pieces.encode(table(folder, "documents", spark), tokenizer(PIECES), keep=["doc_id"])
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"), "agrees",
    )


@query
def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text, learned from three quarters of the documents."""
    docs = table(folder, "documents", spark)
    model = language.learn(docs.where(~language.held_out()), "lang", "text")
    found = language.label(docs, model, keep=["doc_id"])
    return found.select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"),
    )


@query
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes that 50-byte strings of earlier documents cover, removed."""
    found = suffixes.removed(table(folder, "documents", spark))
    return found.select(
        F.col("id").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s[1] - s[0]), F.lit(0)).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


BASE_RULES = [
    urls.host_rule("com", "/", urls.ALLOW), urls.host_rule("example.com", "/en/", urls.BLOCK),
    urls.host_rule("www.example.com", "/en/", urls.ALLOW), urls.host_rule("net", "/es/", urls.BLOCK),
    urls.host_rule("net", "/fr/", urls.BLOCK),
]
# Where no base rule fits: hosts and paths that seldom hold text worth keeping.
#: Words that stand alone in a host or path.
URL_WORDS = (
    "adult", "porn", "xxx", "escort", "casino", "betting", "poker", "torrent", "warez", "keygen", "login", "signin", "signup", "logout",
    "register", "password", "cart", "checkout", "basket", "wishlist", "captcha", "wp-login", "wp-admin", "cgi-bin", "print", "unsubscribe",
)
#: Endings of files without text.
URL_ENDINGS = ("jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "zip", "gz", "rar", "exe", "apk", "css", "js", "mp3", "mp4", "woff")
#: Names of hosts that serve advertisements, files or forms; their manuals stay.
URL_HOSTS = (
    "ad", "ads", "adserver", "banner", "click", "track", "tracker", "pixel", "beacon", "telemetry", "analytics", "metrics",
    "cdn", "static", "assets", "img", "images", "thumbs", "download", "mirror", "proxy", "webmail", "mail", "auth", "sso", "accounts", "pay",
)
URL_SECTIONS = ("docs", "manual", "wiki")
#: Two words joined by a hyphen, one of each list, as names of shops that send junk.
URL_OFFERS = ("cheap", "buy", "best", "free", "discount", "online")
URL_GOODS = (
    "pills", "meds", "pharmacy", "viagra", "cialis", "steroids", "casino", "slots", "poker", "lottery", "loans", "credit",
    "replica", "watches", "handbags", "followers", "likes", "backlinks", "essays", "diplomas", "hosting", "vpn", "crypto", "forex",
)
MORE_RULES = [
    *(urls.Rule(f"^{w}^", urls.BLOCK, w) for w in URL_WORDS),
    *(urls.Rule(f".{e}|", urls.BLOCK, f"*.{e}") for e in URL_ENDINGS),
    *(urls.Rule(f"||{h}.", urls.BLOCK, f"{h}.") for h in URL_HOSTS),
    *(urls.Rule(f"||{h}.*^{s}^", urls.ALLOW, f"{h}./{s}", 1) for h in URL_HOSTS for s in URL_SECTIONS),
    *(urls.Rule(f"||{o}-{g}.", urls.BLOCK, f"{o}-{g}.") for o in URL_OFFERS for g in URL_GOODS),
    *(urls.Rule(f"/{o}-{g}^", urls.BLOCK, f"/{o}-{g}") for o in URL_OFFERS for g in URL_GOODS),
]


@query
def op4_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's address."""
    return urls.judge(table(folder, "pages", spark), BASE_RULES, MORE_RULES, keep=["page_id"]).select(
        "page_id", "host", "path", "rule", "verdict", "pattern",
    )


_RULES = ", ".join(f"('{r.name}', '{r.verdict}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}')" for r in BASE_RULES)
_CUT = r"[^A-Za-z0-9_\-.%]"


def _found(names, before: str, after: str) -> str:
    """SQL for the first name, in alphabetical order, that stands in the address between two expressions."""
    rows = ", ".join(f"('{shown}', '{before.format(*name)}{after.format(*name)}')" for shown, *name in names)
    return f"(SELECT min(shown) FROM (VALUES {rows}) AS n(shown, form) WHERE regexp_matches(address, '(?s)' || form))"


_OFFERS = [(o, g) for o in URL_OFFERS for g in URL_GOODS]
_BLOCKS = ", ".join((
    _found([(w, w) for w in URL_WORDS], _CUT + "{0}", f"({_CUT}|$)"),
    _found([(f"*.{e}", e) for e in URL_ENDINGS], r"\.{0}", "$"),
    _found([(f"{h}.", h) for h in URL_HOSTS], r"^([^/]*\.)?{0}", r"\."),
    _found([(f"{o}-{g}.", f"{o}-{g}") for o, g in _OFFERS], r"^([^/]*\.)?{0}", r"\."),
    _found([(f"/{o}-{g}", f"{o}-{g}") for o, g in _OFFERS], "/{0}", f"({_CUT}|$)"),
))
_STAYS = _found(
    [(f"{h}./{s}", h, s) for h in URL_HOSTS for s in URL_SECTIONS], r"^([^/]*\.)?{0}\..*" + _CUT, f"{{1}}({_CUT}|$)"
)
ORACLES["op4_urls"] = rf"""
WITH cut AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^(.*?)://([^/?#]*)([^?#]*)', 2), '') AS raw_host,
         coalesce(regexp_extract(url, '(?s)^(.*?)://([^/?#]*)([^?#]*)', 3), '') AS path FROM pages),
addresses AS (SELECT page_id, translate(raw_host, '{UPPER}', '{LOWER}') AS host, path FROM cut),
rules(rule, verdict, rule_host, rule_path) AS (VALUES {_RULES}),
fitting AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(rules.verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM addresses) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path),
others AS (
  SELECT host, path, {_STAYS} AS stays, least({_BLOCKS}) AS blocks
  FROM (SELECT DISTINCT host, path, host || path AS address FROM addresses) AS d
  WHERE NOT EXISTS (SELECT 1 FROM fitting f WHERE f.host = d.host AND f.path = d.path))
SELECT page_id, a.host, a.path, rule,
  coalesce(verdict, CASE WHEN stays IS NULL AND blocks IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(stays, blocks) AS pattern
FROM addresses a LEFT JOIN fitting f ON a.host = f.host AND a.path = f.path
LEFT JOIN others o ON a.host = o.host AND a.path = o.path
"""


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = decontaminate.scan(table(folder, "documents", spark), table(folder, "benchmark", spark), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        digest(F.array_join("items", ",")).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def _words_sql(text: str) -> str:
    return (
        f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )


ORACLES["op5_decontamination"] = rf"""
WITH items AS (SELECT item_id, {_words_sql('text')} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM docs, sizes, unnest(range(1, len(w) - size + 2)) AS u(i)),
hits AS (SELECT doc_id, i, d.size, item_id FROM doc_windows d JOIN item_windows b ON d.size = b.size AND d.win = b.win),
places AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM hits), unnest(range(i, i + size)) AS u(j)
  GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN places p ON d.doc_id = p.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""


@query
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in every text."""
    found = licenses.scan(table(folder, "documents", spark), keep=["doc_id"])
    base, more = "base_places.label", "detections.label"
    trust = F.array_max("detections.trust")
    return found.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places.first").cast("long").alias("first_word"), F.array_max("base_places.first").cast("long").alias("last_word"),
        joined(base).alias("base_labels"), F.array_join(F.array_sort(F.array_union(F.col(base), F.col(more))), ",").alias("labels"),
        F.coalesce(trust, F.when(F.size("base_places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


@query
def op7_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose shingle sets are alike."""
    return jaccard.join_groups(table(folder, "documents", spark)).select(
        F.col("id").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), F.col("component").alias("component_id"),
    )


ORACLES["op7_jaccard"] = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
linked AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM documents d JOIN reach r ON d.doc_id = r.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id GROUP BY d.doc_id, n
"""


@query
def op8_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids written to files and read back by key."""
    place = shared_folder(spark, "token-ids")
    entries = token_store.write(table(folder, "documents", spark), place, tokenizer(WORDS), end_id=1)
    return token_store.lookup(spark, place, entries).select(
        F.col("id").alias("doc_id"), "start", F.col("count").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
    )


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without lines that stand, alike, in an earlier place."""
    docs = table(folder, "documents", spark).select("doc_id", "text")
    return lines.dedup(docs, counts=True).select(
        "doc_id", "n_lines", "n_removed", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        digest(F.coalesce("text", F.lit(""))).alias("kept_sha256"),
    )


#: Documents below this mean log ratio go.
QUALITY_THRESHOLD = -0.25


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict on the quality of every document."""
    docs, labels = table(folder, "documents", spark), table(folder, "labels", spark)
    trusted = labels.where("quality = 1 and toxic = 0").select("doc_id")
    ratios = quality.log_ratios(quality.count_grams(docs, trusted))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return quality.score(docs, ratios, keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("score") >= QUALITY_THRESHOLD)).alias("kept"), "score",
    )


@query
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector along the leading 32 eigenvectors of all vectors' covariance, at unit variance."""
    return whitening.whitened(table(folder, "embeddings", spark), components=32)


@query
def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards that each hold the mixture of sources."""
    return sharding.assign(table(folder, "documents", spark), shards=24, seed=0, keep=["doc_id"])


def _crc_sql(raw: str) -> str:
    """CRC-32 of a blob, byte by byte; ``crc_steps``, the usual table, is to be joined."""
    numbers = f"list_transform(regexp_extract_all(hex({raw}), '..'), lambda p: ('0x' || p)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295::BIGINT)"


_CRC_STEPS = """crc_steps AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM range(256) AS r(i))"""

ORACLES["op12_sharding"] = rf"""
WITH {_CRC_STEPS},
docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {_crc_sql("encode(coalesce(text, ''))")} AS text_crc32,
         CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum,
         ('0x' || left(md5(concat_ws(':', '0', doc_id::VARCHAR, md5(coalesce(text, '')))), 15))::BIGINT AS drawn
  FROM documents, crc_steps),
placed AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY drawn)
             - ('0x' || left(md5(concat_ws(':', '0', stratum)), 15))::BIGINT / (1::BIGINT << 60)::DOUBLE)
            / count(*) OVER (PARTITION BY stratum) AS place
  FROM docs),
cut AS (SELECT *, (row_number() OVER (ORDER BY place, stratum, drawn) - 1) * 24 // count(*) OVER () AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, stratum, drawn) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every shared opening of the conversations, rebuilt so that they share some."""
    return prefixes.trie(prefixes.rebuilt(prefixes.turns(table(folder, "conversations", spark))))


ORACLES["op13_prefix_trie"] = rf"""
WITH {_CRC_STEPS},
own AS (
  SELECT conv_id, list({{'t': md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')),
                         'w': len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))}}
                       ORDER BY turn NULLS FIRST, coalesce(role, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT *, {_crc_sql("encode(conv_id::VARCHAR)")} % 4 AS h FROM own, crc_steps),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
members AS (
  SELECT conv_id, d::BIGINT AS depth, len(turns) AS size, array_to_string(list_transform(turns[1:d], lambda x: x.t), ',') AS node,
         CASE WHEN d > 0 THEN array_to_string(list_transform(turns[1:d - 1], lambda x: x.t), ',') END AS parent,
         CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS words
  FROM rebuilt, unnest(range(0, len(turns) + 1)) AS u(d)),
nodes AS (
  SELECT node, depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS tokens,
         coalesce(string_agg(CASE WHEN size = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
  FROM members GROUP BY node, depth),
children AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent, depth),
-- every node with the nodes above it, from one of its members
ways AS (
  SELECT DISTINCT a.node, a.depth, v.node AS low, v.depth AS low_depth
  FROM nodes v JOIN members a ON a.conv_id = v.conv_id AND a.depth <= v.depth),
below AS (
  SELECT w.node, w.depth, sum(v.tokens) AS saved, sum((c.n IS NULL)::INTEGER) AS leaves
  FROM ways w JOIN nodes v ON v.node = w.low AND v.depth = w.low_depth
  LEFT JOIN children c ON c.node = w.low AND c.depth = w.low_depth GROUP BY w.node, w.depth)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b ON b.node = n.node AND b.depth = n.depth
LEFT JOIN nodes p ON p.node = n.parent AND p.depth = n.depth - 1
LEFT JOIN children c ON c.node = n.node AND c.depth = n.depth
"""

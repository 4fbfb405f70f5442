"""The registered queries of the numbered operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.llm.bpe import encode_decode
from voxspark.llm.common import read_table
from voxspark.llm.conversations import damage, repair_report
from voxspark.llm.exact_dedup import exact_duplicates
from voxspark.llm.jaccard import jaccard_components
from voxspark.llm.lang_id import predict_languages
from voxspark.llm.merkle import merkle_manifest
from voxspark.llm.packing import pack
from voxspark.llm.pieces import tokenizer_path
from voxspark.llm.quality import score_documents
from voxspark.llm.secret_scan import secret_spans
from voxspark.llm.suffix_dedup import repeated_bytes
from voxspark.llm.token_counts import token_counts
from voxspark.llm.topk import top_k
from voxspark.llm.url_rules import judge_urls

#: Fixed values: the rules of op4 as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(read_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(read_table(spark, sf_dir, "documents"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(read_table(spark, sf_dir, "pages"), rules)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), words=3, percent=90)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    return top_k(table, table.where(F.col("vec_id") % 20 == 0), 20)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations")
    return repair_report(damage(table), table)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(read_table(spark, sf_dir, "documents"))


def op13_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(read_table(spark, sf_dir, "documents"))


ALL = (
    op1_secret_scan, op2_token_counts, op3_suffix_dedup, op4_url_rules, op5_quality, op6_exact_dedup, op7_bpe, op8_jaccard_join, op9_packing, op10_exact_top_k,
    op11_conversations, op12_merkle, op13_lang_id,
)  # fmt: skip
QUERIES = {f.__name__: f for f in ALL}

#: CRC-32 of a decimal number's text in SQL: a byte at a time, a bit at a time.
CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


def add_edit(state: str, cost: int | str, edit: str) -> str:
    """A cost of six digits and an audit in one text, so that the least text has the least cost and then the least audit."""
    return f"(lpad(CAST(CAST(({state})[1:6] AS INTEGER) + {cost} AS VARCHAR), 6, '0') || '{edit}' || ({state})[7:])"


def repair_step() -> str:
    """Cheapest rests from each phase of the grammar (as in conversations.py), one turn earlier; f: those after it, c: its code."""
    after, letter, found = {0: 2, 1: 2, 2: 3, 3: 2}, {0: "u", 1: "u", 2: "a", 3: "u"}, []
    for p in range(4):
        cut = "CASE WHEN c[1] IN ('S', 'U', 'A', 'X') THEN 1 ELSE 0 END"
        rest = f"f[{after[p] + 1}]"
        kept = f"CASE WHEN lower(c[1]) = '{letter[p]}' THEN {add_edit(rest, cut, 'K')} ELSE {add_edit(rest, f'2 + {cut}', 'R')} END"
        options = [add_edit(f"f[{p + 1}]", 3, "D"), f"CASE WHEN c[1] NOT IN ('b', 'd') THEN {kept} END"]
        if p == 0:
            options.append(f"CASE WHEN lower(c[1]) = 's' THEN {add_edit('f[2]', cut, 'K')} END")
        found.append(f"list_min([{', '.join(options)}])")
    return with_inserts(f"[{', '.join(found)}]")


def with_inserts(rests: str) -> str:
    """Up to three turns put in before each rest; more than that only go round."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    own = []
    for p in range(4):
        q, options = p, [f"g[{p + 1}]"]
        for k in range(1, 4):
            q = after[q]
            options.append(add_edit(f"g[{q + 1}]", 2 * k, "I" * k))
        own.append(f"list_min([{', '.join(options)}])")
    return f"list_transform([{rests}], lambda g: [{', '.join(own)}])[1]"


DUE = "CASE WHEN s[2] = 'u' THEN 'assistant' ELSE 'user' END"
WRITE = "[CAST(CAST(s[1] AS INTEGER) + {turns} AS VARCHAR), ({role})[1:1], s[3] || s[4] || {role} || ':' || {text}, chr(10)]"
TURN = "CAST(s[1] AS INTEGER) + 1"
OP11 = rf"""
        WITH d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                          {CRC32.format("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS hit FROM conversations),
        x AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(range(0, CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE hit <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text[1:64], sha256(text)) AS n, regexp_extract(text, '([^ 	-])[ 	-]*$', 1, 's') AS last FROM x),
        y AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1:1] AS pair,
                     CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'x' END AS initial FROM o),
        z AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN again THEN 'd' WHEN last IN ('.', '!', '?') THEN initial ELSE upper(initial) END AS code FROM y),
        l AS (SELECT conv_id, list(code ORDER BY n) AS codes, list(role ORDER BY n) AS roles, list(text ORDER BY n) AS texts, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE code = 'b') AS blank,
                     count(*) FILTER (WHERE code = 'd') AS duplicate, count(*) FILTER (WHERE code IN ('S', 'U', 'A', 'X')) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM z GROUP BY conv_id),
        b AS (SELECT *, list_reduce(list_prepend({with_inserts("['000000', '500000', '500000', '000000']")}, list_transform(list_reverse(codes), lambda c: [c])), lambda f, c: {repair_step()})[1] AS best FROM l),
        a AS (SELECT *, list_reduce(list_prepend(['0', '', '', ''], list_transform(string_split(best[7:], ''), lambda e: [e])), lambda s, e: CASE e[1]
                WHEN 'D' THEN [CAST({TURN} AS VARCHAR), s[2], s[3], s[4]] WHEN 'I' THEN {WRITE.format(turns=0, role=f"({DUE})", text="''")}
                WHEN 'K' THEN {WRITE.format(turns=1, role=f"roles[{TURN}]", text=f"texts[{TURN}]")} WHEN 'R' THEN {WRITE.format(turns=1, role=f"({DUE})", text=f"texts[{TURN}]")} ELSE s END)[3] AS said FROM b)
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(best[1:6], '0') AS BIGINT) AS cost, coalesce(best[7:], '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN a ON i.conv_id IS NOT DISTINCT FROM a.conv_id"""

ORACLES = {
    "op11_conversations": OP11,
    "op4_url_rules": r"""
        WITH r(rule, rhost, rpath, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                                       ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
        u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages)
        SELECT u.page_id, u.host, u.path, any_value(b.rule) AS rule, coalesce(any_value(b.verdict), 'allow') AS verdict
        FROM u LEFT JOIN (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(r.verdict, length(rule)) AS verdict
                          FROM u JOIN r ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath) GROUP BY page_id) b USING (page_id)
        GROUP BY u.page_id, u.host, u.path""",
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op8_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
              GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) c USING (doc_id)""",
    "op10_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op12_merkle": f"""
        WITH RECURSIVE d AS (SELECT *, CASE WHEN {CRC32.format("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
        f AS (SELECT doc_id, coalesce('1' || source, '0') AS source, text, other, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                     coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head FROM d),
        l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS other FROM f),
        b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM l),
        u AS (SELECT 0 AS h, source, idx, n, leaf AS hash FROM b
              UNION ALL SELECT h + 1, source, idx // 3, any_value((n + 2) // 3), sha256(string_agg(hash, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY h, source, idx // 3),
        s AS (SELECT source, hash, row_number() OVER (ORDER BY source) - 1 AS idx, count(*) OVER () AS n FROM u WHERE n = 1),
        r AS (SELECT 0 AS h, idx, n, hash FROM s UNION ALL SELECT h + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(hash, '' ORDER BY idx)) FROM r WHERE n > 1 GROUP BY h, idx // 3),
        i AS (SELECT source, b.idx AS leaf_idx, u.h, u.idx, u.hash, b.idx // CAST(3 ** u.h AS BIGINT) AS own FROM b JOIN u USING (source) WHERE u.n > 1 AND u.idx // 3 = b.idx // CAST(3 ** (u.h + 1) AS BIGINT)
              UNION ALL SELECT b.source, b.idx, 1000 + r.h, r.idx, r.hash, s.idx // CAST(3 ** r.h AS BIGINT) FROM b JOIN s USING (source) JOIN r ON r.n > 1 AND r.idx // 3 = s.idx // CAST(3 ** (r.h + 1) AS BIGINT)),
        p AS (SELECT source, leaf_idx, h, coalesce(string_agg(hash, '' ORDER BY idx) FILTER (WHERE idx < own), '') AS a, coalesce(string_agg(hash, '' ORDER BY idx) FILTER (WHERE idx > own), '') AS z FROM i GROUP BY ALL),
        q AS (SELECT source, leaf_idx, string_agg(a || z, '' ORDER BY h) AS proof, list(a || '|' || z ORDER BY h) AS steps FROM p GROUP BY ALL)
        SELECT doc_id, leaf, s.hash AS subroot, (SELECT hash FROM r WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
               list_reduce(list_prepend(other, coalesce(steps, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root, folded_root = (SELECT hash FROM r WHERE n = 1) AS verified
        FROM b JOIN s USING (source) LEFT JOIN q ON q.source = b.source AND q.leaf_idx = b.idx""",
}

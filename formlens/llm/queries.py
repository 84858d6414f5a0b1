"""The operators as registered queries over the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.llm import language, pii, quality
from formlens.llm.collocations import collocations
from formlens.llm.common import stored
from formlens.llm.decontamination import find_items
from formlens.llm.line_dedup import dedup_lines
from formlens.llm.packing import pack_documents
from formlens.llm.prefix_trie import numbered_turns, prefix_trie, shared_heads
from formlens.llm.simhash import near_duplicates
from formlens.llm.suffix_dedup import remove_repeats
from formlens.llm.token_counts import count_tokens
from formlens.llm.vector_dedup import near_vectors
from formlens.llm.warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The chance that a document is of quality 1, by a factorisation machine."""
    docs = table(spark, folder, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, folder, "labels")))


@query
def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document and how many spans of one language it has."""
    docs = table(spark, folder, "documents")
    labelled = language.label_languages(docs, language.train(docs), keep=["doc_id"])
    return labelled.select(
        "doc_id",
        language.held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.size("lang_spans").alias("n_spans"),
    )


@query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's record, read back from dictionary-compressed archives."""
    records = archive_pages(table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op3_warc"] = """
WITH payloads AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, hex, max(page_id) OVER (PARTITION BY hex) AS latest,
           list_aggregate(list_transform(range(0, 40), lambda i:
               ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
               [instr('0123456789abcdef', substr(hex, CAST(i AS INT) + 1, 1))]), 'string_agg', '') AS ones
    FROM payloads
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
           16 * CAST(substr(ones, CAST(5 * i AS INT) + 1, 1) AS INT) + 8 * CAST(substr(ones, CAST(5 * i AS INT) + 2, 1) AS INT) +
           4 * CAST(substr(ones, CAST(5 * i AS INT) + 3, 1) AS INT) + 2 * CAST(substr(ones, CAST(5 * i AS INT) + 4, 1) AS INT) +
           CAST(substr(ones, CAST(5 * i AS INT) + 5, 1) AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM bits"""


@query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's SimHash and its group of near-duplicates."""
    return near_duplicates(table(spark, folder, "documents"))


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and byte-level BPE tokens of every document, and whether it has over 1,024."""
    return count_tokens(table(spark, folder, "documents"))


@query
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data of every document."""
    docs = table(spark, folder, "documents")
    return pii.find_personal_data(docs, pii.train(docs))


@query
def op7_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's number of near ones, and its group."""
    return near_vectors(table(spark, folder, "embeddings"))


# The smallest id reachable: every pair of linked vectors, then rounds of the smallest neighbour.
SQL["op7_vectors"] = """
WITH RECURSIVE fine AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fine a, fine b WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      AND list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.9
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), named AS (
    SELECT e.vec_id, least(e.vec_id, coalesce(min(r.b), e.vec_id)) AS component_id
    FROM embeddings e LEFT JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
)
SELECT n.vec_id, (SELECT count(*) FROM links l WHERE l.a = n.vec_id) AS n_links, n.component_id,
       n.vec_id = n.component_id AS kept
FROM named n"""


@query
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the runs of lines, of 50 words or more, that repeat earlier ones."""
    deduplicated = dedup_lines(table(spark, folder, "documents"))
    return deduplicated.select("doc_id", "text", "n_lines", "n_deleted")


# All runs of 50 words, from and up to every line, compared as texts.
SQL["op8_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
    FROM documents WHERE text IS NOT NULL
), parts AS (
    SELECT *, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS words FROM lines
), folded AS (
    SELECT doc_id, n, line, array_to_string(words, ' ') AS folded, len(words) AS size,
           sum(len(words)) OVER (PARTITION BY doc_id ORDER BY n) AS upto
    FROM parts
), runs AS (
    SELECT a.doc_id, a.n AS start, b.n AS stop FROM folded a JOIN folded b
      ON a.doc_id = b.doc_id AND a.n <= b.n AND b.upto - a.upto + a.size >= 50
), windows AS (
    SELECT doc_id, start, min(stop) AS stop FROM runs GROUP BY doc_id, start
    UNION SELECT doc_id, max(start) AS start, stop FROM runs GROUP BY doc_id, stop
), spelled AS (
    SELECT w.doc_id, w.start, w.stop, string_agg(f.folded, chr(10) ORDER BY f.n) AS run
    FROM windows w JOIN folded f ON f.doc_id = w.doc_id AND f.n BETWEEN w.start AND w.stop GROUP BY w.doc_id, w.start, w.stop
), later AS (
    SELECT doc_id, start, stop FROM (
        SELECT *, min(struct_pack(d := doc_id, s := start)) OVER (PARTITION BY run) AS first FROM spelled)
    WHERE first <> struct_pack(d := doc_id, s := start)
), gone AS (
    SELECT DISTINCT f.doc_id, f.n FROM folded f JOIN later l ON f.doc_id = l.doc_id AND f.n BETWEEN l.start AND l.stop
), kept AS (
    SELECT f.doc_id, string_agg(f.line, chr(10) ORDER BY f.n) FILTER (g.n IS NULL) AS text,
           count(*) AS n_lines, count(g.n) AS n_deleted
    FROM folded f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.n = g.n GROUP BY f.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_deleted, 0) AS INTEGER) AS n_deleted
FROM documents d LEFT JOIN kept k USING (doc_id)"""


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a window of 2,048 tokens."""
    return pack_documents(table(spark, folder, "documents"))


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark items that every document holds, up to edits of a fifth of their length."""
    found = find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    n_items = F.size("items_found")
    return found.select("doc_id", (n_items > 0).alias("contaminated"), n_items.alias("n_items"), "items_found")


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct sequence of first turns of the conversations, with totals of its subtree."""
    turns = stored(numbered_turns(table(spark, folder, "conversations")), "turns")
    return prefix_trie(*shared_heads(turns))


# A node is its smallest member and depth; prefixes are compared as lists, and the nodes above a node are prefixes of that member.
SQL["op11_prefix_trie"] = r"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
    FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
    SELECT conv_id, count(*) AS size,
           xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, 1 + len(conv_id::VARCHAR)),
               lambda p: ascii(substr(conv_id::VARCHAR, p::INT, 1))::BIGINT)),
               lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
                   lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) % 9 AS h
    FROM turns GROUP BY conv_id
), heads AS (
    SELECT c.conv_id, c.conv_id - c.conv_id % 5 AS head, c.h, least(c.h, coalesce(b.size, 0)) AS taken,
           least(c.h, coalesce(b.size, 0)) + greatest(c.size - c.h, 0) AS total
    FROM sizes c LEFT JOIN sizes b ON b.conv_id = c.conv_id - c.conv_id % 5
), rebuilt AS (
    SELECT h.conv_id, t.n AS depth, t.role, t.text, h.total FROM heads h JOIN turns t ON t.conv_id = h.head AND t.n <= h.taken
    UNION ALL
    SELECT h.conv_id, h.taken + t.n - h.h, t.role, t.text, h.total FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.n > h.h
), prefixes AS (
    SELECT conv_id, depth, total, strlen(text) AS n_bytes,
           list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix
    FROM rebuilt
    UNION ALL SELECT conv_id, 0, total, 0, [] FROM heads
), named AS (
    SELECT *, min(conv_id) OVER (PARTITION BY prefix) AS least FROM prefixes
), nodes AS (
    SELECT least, depth, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = total), '')) AS ends_sha256
    FROM named GROUP BY least, depth
), edges AS (
    SELECT n.*, p.least AS parent FROM nodes n LEFT JOIN named p ON p.conv_id = n.least AND p.depth = n.depth - 1
), children AS (
    SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM edges WHERE depth > 0 GROUP BY ALL
), whole AS (
    SELECT e.*, coalesce(c.n_children, 0) AS n_children
    FROM edges e LEFT JOIN children c ON c.parent = e.least AND c.depth = e.depth
), totals AS (
    SELECT a.least, a.depth, sum((w.n_children = 0)::INT) AS n_leaves, sum((w.n_convs - 1) * w.n_bytes) AS saved_tokens
    FROM whole w JOIN named a ON a.conv_id = w.least AND a.depth <= w.depth GROUP BY ALL
)
SELECT w.least AS conv_id, w.depth::BIGINT AS depth, w.parent AS parent_conv_id, w.n_convs, w.n_children::BIGINT AS n_children,
       t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w JOIN totals t ON t.least = w.least AND t.depth = w.depth"""


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 phrases of two to four words of every language."""
    return collocations(table(spark, folder, "documents"))


# Every phrase of one to four words, spelled and counted.
SQL["op12_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece
    FROM documents
), parts AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda w: w <> '') AS words FROM pieces
), phrases AS (
    SELECT lang, k, array_to_string(list_slice(words, i, i + k - 1), ' ') AS phrase
    FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM parts, range(1, 5) t(k))
), f AS (
    SELECT lang, k, phrase, count(*) AS a FROM phrases GROUP BY ALL
), candidates AS (
    SELECT lang, k, phrase, a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND a >= 30
), inside AS (
    SELECT DISTINCT c.lang, array_to_string(list_slice(c.words, i, i + m - 1), ' ') AS phrase, c.a
    FROM (SELECT c.*, m, unnest(range(1, k - m + 2)) AS i FROM candidates c, range(2, 4) t(m) WHERE m < k) c
), longer AS (
    SELECT lang, phrase, max(a) AS a FROM inside GROUP BY ALL
), kept AS (
    SELECT c.* FROM candidates c LEFT JOIN longer o USING (lang, phrase)
    WHERE o.a IS NULL OR 100 * o.a::HUGEINT < 80 * c.a::HUGEINT
), cuts AS (
    SELECT c.lang, c.phrase, c.a, i, l.a AS l, r.a AS r, (2000000 * c.a::HUGEINT // (l.a + r.a))::BIGINT AS score
    FROM (SELECT kept.*, unnest(range(1, k)) AS i FROM kept) c
    JOIN f l ON l.lang = c.lang AND l.k = c.i AND l.phrase = array_to_string(list_slice(c.words, 1, c.i), ' ')
    JOIN f r ON r.lang = c.lang AND r.k = c.k - c.i AND r.phrase = array_to_string(list_slice(c.words, c.i + 1, c.k), ' ')
), scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), n AS (
    SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored JOIN n USING (lang) QUALIFY rank <= 2000"""


@query
def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What every document keeps without the bytes of 100-byte strings that start earlier, too."""
    result = remove_repeats(table(spark, folder, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, run: total + run["stop"] - run["start"])
    return result.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        n_removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# Every string of 100 bytes, grouped; later starts in one run as long as their strings touch.
SQL["op13_suffix_dedup"] = """
WITH texts AS (
    SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), starts AS (
    SELECT doc_id, s, array_slice(b, s + 1, s + 100) AS string FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS s FROM texts)
), firsts AS (
    SELECT string, min(struct_pack(d := doc_id, s := s)) AS first FROM starts GROUP BY string HAVING count(*) > 1
), later AS (
    SELECT doc_id, s, s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, -1) AS begins
    FROM starts JOIN firsts USING (string) WHERE first <> struct_pack(d := doc_id, s := s)
), numbered AS (
    SELECT doc_id, s, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM later
), runs AS (
    SELECT doc_id, min(s) AS start, max(s) + 100 AS stop, lag(max(s) + 100, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS upto
    FROM numbered GROUP BY doc_id, run
), cut AS (
    SELECT t.doc_id, count(*) AS n_spans, sum(r.stop - r.start) AS n_removed,
           unhex(coalesce(string_agg(hex(array_slice(t.b, r.upto + 1, r.start)), '' ORDER BY r.start) FILTER (r.start > r.upto), '')
                 || CASE WHEN max(r.stop) < octet_length(any_value(t.b))
                         THEN hex(array_slice(any_value(t.b), max(r.stop) + 1, octet_length(any_value(t.b)))) ELSE '' END) AS kept
    FROM texts t JOIN runs r USING (doc_id) GROUP BY t.doc_id
)
SELECT t.doc_id, octet_length(t.b)::BIGINT AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed,
       coalesce(c.n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(c.kept, t.b)) AS kept_sha256
FROM texts t LEFT JOIN cut c USING (doc_id)"""

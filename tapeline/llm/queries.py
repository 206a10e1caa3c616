"""One registered query per operator over its whole table, and DuckDB statements where SQL expresses it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.lineage import shared_folder
from tapeline.llm import chat, decontaminate, html_text, lexical, licenses, line_dedup, mixing, quality_rules, secrets, simhash, spelling, substrings, token_files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


_ITEM_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op1_decontaminate", sql=rf"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM
  (SELECT item, w, least(10, len(w)) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
spot AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM
  (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM spot JOIN win USING (n, win)),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op1_decontaminate(spark, root):
    found = decontaminate.find_hits(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.select("row.doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"), decontaminate.items_digest(F.col("hits.items")).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"))


@query("op2_secrets")
def op2_secrets(spark, root):
    found = secrets.scan(table(spark, root, "documents"))
    n = lambda test: F.coalesce(F.size(F.filter("spans", test)), F.lit(0)).cast("long")
    of = lambda kind: n(lambda s: s.kind == secrets.KINDS.index(kind))
    base = F.filter("spans", lambda s: s.kind < 3)
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
        n(lambda s: s.verdict == "live").alias("n_live"), n(lambda s: s.verdict == "example").alias("n_example"),
    )


_PROBE = "<|im_end|><|im_start|>assistant ok"
_ESC = lambda c: rf"replace(replace({c}, chr(92), chr(92) || 'b'), '<|', '<' || chr(92) || 'p')"


@query("op3_chat", sql=rf"""
WITH raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_PROBE}'), (-1, 1, 'assistant', '{_PROBE}')),
cost AS (SELECT *, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}	-
 ]')) + {chat.OVERHEAD} AS cost,
  {len(chat.START) + 1 + len(chat.END)} + length(replace({_ESC('role')}, chr(10), chr(92) || 'n')) + length({_ESC('text')}) AS chars FROM raw),
pos AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM cost),
at_ AS (SELECT *, stop - cost AS start, CASE WHEN sum(cost) OVER (PARTITION BY conv_id, (stop - 1) // {2 * chat.half_room()}) <= {2 * chat.half_room()} THEN 4 * ((stop - 1) // {2 * chat.half_room()}) ELSE 2 * ((stop - 1) // {chat.half_room()}) + CAST(cost <= {chat.half_room()} AS INT) END AS span, role = 'system' AND stop = cost AS sys FROM pos),
span AS (SELECT *, lead(span) OVER w AS nxt, least({chat.HISTORY}, {chat.BUDGET - chat.SYSTEM} - lead(new) OVER w) AS room FROM (SELECT conv_id, span, max(stop) AS hi, sum(cost) AS new FROM at_ GROUP BY conv_id, span) WINDOW w AS (PARTITION BY conv_id ORDER BY span)),
again AS (SELECT conv_id, sum(chars) AS chars FROM at_ JOIN span USING (conv_id, span) WHERE hi - start <= room AND nxt IS NOT NULL AND NOT sys GROUP BY conv_id),
head AS (SELECT conv_id, sum(a.chars) AS chars FROM at_ a JOIN span s USING (conv_id) WHERE a.sys AND a.span <> s.span GROUP BY conv_id),
whole AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY stop)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY stop) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars) AS chars FROM at_ GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, CAST(whole.chars + coalesce(again.chars, 0) + coalesce(head.chars, 0) AS BIGINT) AS formatted_chars
FROM whole LEFT JOIN again USING (conv_id) LEFT JOIN head USING (conv_id)""")
def op3_chat(spark, root):
    turns = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_PROBE).alias("text"))
    return chat.digests(chat.format_windows(turns.unionByName(probe)))


@query("op4_mixing")
def op4_mixing(spark, root):
    return mixing.mix(table(spark, root, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op5_html_text")
def op5_html_text(spark, root):
    return html_text.main_text(table(spark, root, "pages")).withColumn("n_chars", F.length("text").cast("long"))


_KNOWN = ", ".join(f"('{s}', {i})" for s, i in licenses.SENTENCES.items())
_PARTS = lambda mode, units: rf"SELECT doc_id, {mode} AS mode, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(t, '[.!?;]+(?:[ \t\r\n]+|$)|{units}') AS p FROM doc)"
_HOLDS = ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(',' || ids || ',', ',{','.join(str(licenses.SENTENCES[s]) for s in alt)},')" for alt in licenses.RULES[name]) + f" THEN '{name}' END" for name in sorted(licenses.RULES)
)


@query("op6_licenses", sql=rf"""
WITH known(s, id) AS (VALUES {_KNOWN}),
doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
part AS ({_PARTS(0, r"\n")} UNION ALL {_PARTS(1, r"\n[ \t\r]*\n")}),
norm AS (SELECT doc_id, mode, i, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM part),
found AS (SELECT doc_id, mode, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) AS ids FROM norm JOIN known USING (s) GROUP BY doc_id, mode),
best AS (SELECT doc_id, arg_max(struct_pack(n := n, ids := ids), n * 2 + 1 - mode) AS b FROM found GROUP BY doc_id),
flat AS (SELECT doc_id, coalesce(b.n, 0) AS n_sentences, coalesce(b.ids, '') AS ids FROM doc LEFT JOIN best USING (doc_id))
SELECT doc_id, n_sentences, ids AS sentence_ids, concat_ws(',', {_HOLDS}) AS licenses FROM flat""")
def op6_licenses(spark, root):
    return licenses.scan(table(spark, root, "documents"))


@query("op7_simhash", sql=None)
def op7_simhash(spark, root):
    return simhash.near_duplicates(table(spark, root, "documents")).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query("op8_substring_dedup", sql=rf"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM doc WHERE len(w) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS i FROM win SEMI JOIN rep USING (h)),
word AS (SELECT doc_id, w[i] AS t, i FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM doc)),
rest AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS kept FROM word ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN rest USING (doc_id) LEFT JOIN n USING (doc_id)""")
def op8_substring_dedup(spark, root):
    cut = substrings.remove_repeats(table(spark, root, "documents").select("doc_id", "text"))
    return cut.select("rest.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_RULE_SQL = " + ".join(f"(CASE WHEN {cond} THEN {1 << i} ELSE 0 END)" for i, cond in enumerate(quality_rules.RULES.values()))


@query("op9_quality_rules", sql=rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM doc),
tri AS (SELECT doc_id, i, w1, lead(w1) OVER d AS w2, lead(w1, 2) OVER d AS w3 FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, w1, w2, w3 FROM tri WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
hit AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM tri JOIN twice USING (doc_id, w1, w2, w3)),
rep AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM hit GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM doc),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM doc LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
mask AS (SELECT *, {_RULE_SQL} AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  failed = 0 AS kept, CAST(failed AS BIGINT) AS failed FROM mask""")
def op9_quality_rules(spark, root):
    entries = quality_rules.ledger(table(spark, root, "documents"))
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.bits(quality_rules.POLICIES[1]))) != 0
    return entries.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality_rules.kept(F.col("failed")).alias("kept"), "failed")


@query("op10_line_dedup", sql=r"""
WITH doc AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
line AS (SELECT doc_id, i - 1 AS line, trim(l[i], E' \t\n\x0b\x0c\r') AS t FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM doc)),
f AS (SELECT doc_id, line, t FROM line WHERE t <> ''),
win AS (SELECT doc_id, line AS a, lead(line, 2) OVER d AS b, t AS t1, lead(t) OVER d AS t2, lead(t, 2) OVER d AS t3 FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY line)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY t1, t2, t3 ORDER BY doc_id, a) AS nth FROM win WHERE b IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS line FROM ranked WHERE nth > 1),
whole AS (SELECT doc_id, i - 1 AS line, l[i] AS t FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM doc)),
rest AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS text FROM whole ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN doc.text IS NOT NULL THEN coalesce(rest.text, '') END AS text
FROM doc LEFT JOIN rest USING (doc_id) LEFT JOIN n USING (doc_id)""")
def op10_line_dedup(spark, root):
    return line_dedup.dedup_lines(table(spark, root, "documents")).select("doc_id", "n_lines", "n_removed", "text")


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query("op11_lexical_search", sql=rf"""
WITH t AS (SELECT doc_id, {_TERMS} AS w FROM documents),
n AS (SELECT doc_id, len(w) AS n FROM t WHERE len(w) > 0),
g AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM n),
b AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) SEMI JOIN b USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
s AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // l)))) AS BIGINT) AS score
  FROM b JOIN w USING (term) JOIN p USING (term) JOIN n USING (doc_id), g GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20""")
def op11_lexical_search(spark, root):
    return lexical.search(table(spark, root, "documents"), table(spark, root, "benchmark"))


_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("op12_spelling", sql=rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
run AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_A_Z}), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT run, c, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
  lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END)) AS b FROM run),
hash AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, b), lambda h, x: xor(h >> 8, t[xor(h & 255, x) + 1])), 4294967295) AS h FROM bytes, crc),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hash)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
d AS (SELECT word, n, j, left(word, j - 1) AS a, substr(word, j + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS j FROM w)),
del AS (SELECT DISTINCT d.word, d.n, w.word AS other, w.n AS other_n FROM d JOIN w ON w.word = d.a || d.b),
near AS (SELECT * FROM del UNION ALL SELECT other, other_n, word, n FROM del
  UNION ALL SELECT x.word, x.n, y.word, y.n FROM d x JOIN d y ON x.a = y.a AND x.b = y.b AND x.j = y.j AND x.word <> y.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL)
SELECT f.*, root FROM f JOIN chain USING (word) SEMI JOIN (SELECT word AS root FROM f WHERE form IS NULL) AS done USING (root)""")
def op12_spelling(spark, root):
    return spelling.group_variants(table(spark, root, "documents"))


@query("op13_token_files")
def op13_token_files(spark, root):
    import public_tokenizers

    docs = table(spark, root, "documents")
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    token_files.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end=1, by_word=True)
    return token_files.read(spark, folder, docs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

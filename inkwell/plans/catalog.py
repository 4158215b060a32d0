"""The registered queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell import hashing, textfn
from inkwell.functions import cleaning, decode, emoji
from inkwell.operators import decontam, dedup, gates, metrics, ranking, sampling
from inkwell.plans import corpora, evaluation, releases, rows, streams  # noqa: F401  (they register their queries)
from inkwell.plans.registry import LABELLED as _LABELLED
from inkwell.plans.registry import ORACLES, QUERIES, docs_of, duck_mod, labelled, query, score, table, text_type  # noqa: F401
from inkwell.plans.registry import SCORE as _SCORE
from inkwell.plans.registry import TYPES as _TYPES
from inkwell.sources import passages, store
from inkwell.streaming.scoring import resumable_scores

_GRAMS = """
CASE WHEN len(w) >= 13 THEN list_distinct(list_transform(range(1, (len(w) - 11)::BIGINT), lambda i: array_to_string(w[i:i+12], ' ')))
     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END
"""


@query(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents WHERE lang = 'en'),
b AS (SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM benchmark),
ref AS (SELECT DISTINCT unnest({_GRAMS}) AS g FROM b),
x AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM d)
SELECT doc_id, count(*)::BIGINT AS n_shared FROM x SEMI JOIN ref USING (g) GROUP BY doc_id HAVING count(*) >= 2
""")
def decontam_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    ref = decontam.reference(table(spark, sf_dir, "benchmark"))
    return decontam.overlap(docs, ref).where(F.col("n_shared") >= decontam.MIN_SHARED)


@query(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents WHERE lang = 'en'),
b AS (SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations)),
ref AS (SELECT DISTINCT unnest({_GRAMS}) AS g FROM b),
x AS (SELECT doc_id, unnest({_GRAMS}) AS g FROM d)
SELECT doc_id, count(*)::BIGINT AS n_shared FROM x SEMI JOIN ref USING (g) GROUP BY doc_id
""")
def reference_index_overlap(spark, sf_dir):
    """Two reference corpora in one kept index, the second added to the first; documents' overlap with both."""
    index = decontam.GramIndex(spark, store.folder(spark))
    index.add("benchmark", table(spark, sf_dir, "benchmark"))
    index.add("conversations", table(spark, sf_dir, "conversations"))
    return index.overlap(table(spark, sf_dir, "documents").where("lang = 'en'"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::BIGINT AS n_words,
  len(regexp_extract_all(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}]'))::BIGINT AS n_cjk,
  lang <> 'en' AND false OR lang = 'en' AND len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) >= 75 AS floor_ok FROM documents""")
def word_cjk_counts(spark, sf_dir):
    t = F.col("text")
    return docs_of(spark, sf_dir).select("doc_id", textfn.word_count(t).cast("long").alias("n_words"), F.regexp_count(t, F.lit(textfn.CJK)).cast("long").alias("n_cjk"), gates.passes_floor(t, F.col("lang")).alias("floor_ok"))


_ASCII_CLEAN = r"""trim(regexp_replace(lower(CASE WHEN len(ps) > 1 AND regexp_matches(regexp_replace(ps[1], '^[^a-zA-Z0-9]*', ''), '^(Sure|Here|Abstract|Title|I''m happy to help|Certainly)')
  THEN array_to_string(ps[2:], chr(10)) ELSE t END), '\s+', ' ', 'g'))"""


@query(rf"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Sure, here it is:' || chr(10) || text ELSE text END AS t FROM documents),
y AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda p: trim(regexp_replace(p, '\s', '', 'g')) <> '') AS ps FROM x)
SELECT doc_id, {_ASCII_CLEAN} AS clean FROM y""")
def clean_text_ascii(spark, sf_dir):
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Sure, here it is:\n"), F.col("text"))).otherwise(F.col("text"))
    return docs_of(spark, sf_dir).select("doc_id", cleaning.clean_ascii(t).alias("clean"))


@query()
def clean_text_full(spark, sf_dir):
    d = cleaning.clean_text(docs_of(spark, sf_dir).select("doc_id", "text"), "text", "clean")
    return d.select("doc_id", "clean", cleaning.strip_wrapper(F.col("text")).alias("wrapper"))


#: Sequences that go into texts by turns, and their published names.
_EMOJI = [(c, emoji.token(n)) for c, n in sorted(emoji.named().items())] + [
    ("\u2764\ufe0f", ":red_heart:"), ("#\ufe0f\u20e3", ":keycap_#:"), ("9\u20e3", ":keycap_9:"), ("\U0001F1FA\U0001F1F8", ":United_States:"), ("\U0001F1EF\U0001F1F5", ":Japan:"),
    ("\U0001F44D\U0001F3FD", ":thumbs_up_medium_skin_tone:"), ("\U0001F9D4\U0001F3FF", ":person_dark_skin_tone_beard:"), ("\U0001F937\u200d\u2640\ufe0f", ":woman_shrugging:"),
    ("\U0001F600", ":grinning_face:"), ("\U0001F680", ":rocket:"), ("\U0001F525\U0001F525", ":fire::fire:"), ("\U0001F553", ":four_o’clock:"),
]


@query(f"""WITH e AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, (_, t) in enumerate(_EMOJI))}) AS v(i, token))
SELECT doc_id, concat(token, text, token) AS named FROM documents JOIN e ON i = doc_id % {len(_EMOJI)}""")
def emoji_tokens(spark, sf_dir):
    seq = F.element_at(F.array(*[F.lit(c) for c, _ in _EMOJI]), (F.col("doc_id") % len(_EMOJI) + 1).cast("int"))
    text = F.concat(seq, F.col("text"), seq)
    return docs_of(spark, sf_dir).select("doc_id", emoji.emoji_names(text, flags=emoji.regions(spark)).alias("named"))


_PLAIN = "text"
for _pattern, _to in [(r"https?://\S+", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^\s{0,3}#{1,6}\s*", ""), (r"(?m)^\s{0,3}>\s?", ""), (r"(?m)^\s{0,3}[-*+]\s+", ""), ("`{1,3}", ""), (r"\*\*\*|\*\*|\*|__|_|~~", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")]:
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', '{_to}', 'g')"


@query(rf"""WITH x AS (SELECT doc_id, text, lang, {_PLAIN} AS plain, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
y AS (SELECT *, CASE WHEN regexp_matches(t, '(?s)^.*?[.!?]\s') THEN regexp_extract(t, '(?s)^(.*?[.!?])\s', 1) ELSE t END AS s, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS nw FROM x)
SELECT doc_id, plain, CASE WHEN lang = 'en' THEN array_to_string(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')[1:12], ' ') ELSE substr(regexp_split_to_array(t, '[。！？\n]')[1], 1, 30) END AS topic,
 CASE WHEN lang = 'en' THEN greatest(50, round_even(nw / 25, 0) * 25)::INT || ' words' ELSE greatest(150, round_even(len(text) / 50, 0) * 50)::INT || '字' END AS hint FROM y""")
def post_text(spark, sf_dir):
    t = F.col("text")
    return docs_of(spark, sf_dir).select("doc_id", cleaning.clean_post(t).alias("plain"), cleaning.topic(t, F.col("lang")).alias("topic"), cleaning.length_hint(t, F.col("lang")).alias("hint"))


def _gate_rows(spark, sf_dir, *more):
    """Documents as mirrors and edits of the document before them, with the columns ``more``; some refuse, some
    are in simplified characters. Human texts have no source, so they stay where they are read."""
    d = store.spread(docs_of(spark, sf_dir))
    ai = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    src = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("source_text")).where(ai)
    d = d.where(ai).join(src, "doc_id", "left").unionByName(d.where(~ai).withColumn("source_text", F.lit(None).cast("string")))
    han = F.col("doc_id") % 17 == 1
    text = F.when(F.col("doc_id") % 13 == 1, F.concat(F.lit("I cannot help. "), "text")).when(han, F.concat(F.lit("们这国东京都"), "text")).otherwise(F.col("text"))
    return d.select(
        "doc_id", text.alias("text"), F.when(han, "zh-tw").otherwise(F.col("lang")).alias("language"), text_type().alias("text_type"), "source_text",
        F.when(F.col("doc_id") % 11 == 0, "length").otherwise("stop").alias("finish_reason"), *more,
    )


_CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}]"
_REFUSED = "|".join(gates.REFUSALS).replace("'", "''")


def _duck_grams(units: str, keys: str, words: int, chars: int) -> str:
    """SQL for the n-grams of the units (``y`` at ``i`` of ``n``) of each key in ``units``: words if ``en``."""
    over = f"string_agg(y, ' ') OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN CURRENT ROW AND {{}} FOLLOWING)"
    return " UNION ALL ".join(f"SELECT {keys}, g FROM (SELECT {keys}, n, i, {over.format(k - 1)} AS g FROM {units} WHERE {side}) WHERE i <= n - {k - 1}" for side, k in (("en", words), ("NOT en", chars)))


@query(rf"""WITH d AS (SELECT a.doc_id, CASE WHEN a.doc_id % 13 = 1 THEN 'I cannot help. ' || a.text WHEN a.doc_id % 17 = 1 THEN '们这国东京都' || a.text ELSE a.text END AS text,
  CASE WHEN a.doc_id % 17 = 1 THEN 'zh-tw' ELSE a.lang END AS lang, {_TYPES.replace('doc_id', 'a.doc_id')} AS tt, b.text AS src, CASE WHEN a.doc_id % 11 = 0 THEN 'length' ELSE 'stop' END AS fr
  FROM documents a LEFT JOIN documents b ON b.doc_id + 1 = a.doc_id),
w AS (SELECT *, len(regexp_extract_all(text, CASE WHEN lang = 'en' THEN '[\p{{L}}\p{{N}}_]+' ELSE '{_CJK}' END)) AS nt, len(regexp_extract_all(src, CASE WHEN lang = 'en' THEN '[\p{{L}}\p{{N}}_]+' ELSE '{_CJK}' END)) AS ns,
  CASE WHEN lang = 'en' THEN list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') ELSE string_split(text, '') END AS tu,
  CASE WHEN lang = 'en' THEN list_filter(regexp_split_to_array(src, '\s+'), lambda x: x <> '') ELSE string_split(src, '') END AS su FROM d),
z AS (SELECT doc_id, side, en, len(u) AS n, unnest(u) AS y, generate_subscripts(u, 1) AS i FROM (SELECT doc_id, 1 AS side, lang = 'en' AS en, tu AS u FROM w WHERE tt = 'ai_generated' UNION ALL SELECT doc_id, 2, lang = 'en', su FROM w WHERE tt = 'ai_generated')),
g AS ({_duck_grams('z', 'doc_id, side', 15, 30)}),
copied AS (SELECT DISTINCT x.doc_id FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.g = y.g AND x.side = 1 AND y.side = 2)
SELECT doc_id, CASE WHEN tt <> 'human_written' AND trim(regexp_replace(text, '\s', '', 'g')) = '' THEN 'empty'
 WHEN tt <> 'human_written' AND fr = 'length' THEN 'truncated'
 WHEN tt <> 'human_written' AND regexp_matches(lower(substr(text, 1, 200)), '{_REFUSED}') THEN 'refusal'
 WHEN tt <> 'human_written' AND lang = 'zh-tw' AND nt > 0 AND len(regexp_replace(text, '[^{gates.SIMPLIFIED}]', '', 'g')) / nt > {gates.SIMPLIFIED_SHARE} THEN 'wrong_script_simplified'
 WHEN tt = 'ai_generated' AND src <> '' AND ns > 0 AND (nt / ns < 0.33 OR nt / ns > 3.0) THEN 'length_mismatch'
 WHEN doc_id IN (SELECT doc_id FROM copied) THEN 'regurgitation'
 WHEN tt = 'ai_edited' AND src <> '' AND regexp_replace(text, '^\s+|\s+$', '', 'g') = regexp_replace(src, '^\s+|\s+$', '', 'g') THEN 'noop_edit' END AS drop_reason FROM w""")
def gate_first_failure(spark, sf_dir):
    return _gate_rows(spark, sf_dir).select("doc_id", gates.drop_reason().alias("drop_reason"))


_SETS = rf"""WITH RECURSIVE t AS (SELECT doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM documents WHERE text IS NOT NULL),
u AS (SELECT *, CASE WHEN lang = 'en' THEN list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '') ELSE list_filter(string_split(x, ''), lambda y: y <> '') END AS w FROM t),
z AS (SELECT doc_id, coalesce(lang = 'en', false) AS en, len(w) AS n, unnest(w) AS y, generate_subscripts(w, 1) AS i FROM u),
s AS (SELECT doc_id, list_sort(list(DISTINCT hash(g))) AS g FROM ({_duck_grams('z', 'doc_id', 5, 10)} UNION ALL SELECT doc_id, 'whole ' || x FROM u WHERE len(w) < CASE WHEN lang = 'en' THEN 5 ELSE 10 END) GROUP BY doc_id),
k AS MATERIALIZED (SELECT min(doc_id) AS id, lang, g FROM s JOIN t USING (doc_id) GROUP BY lang, g),
e AS (SELECT id, lang, len(g) AS n, unnest(g) AS x FROM k),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.lang = b.lang AND a.id < b.id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY a.id, b.id),
p AS MATERIALIZED (SELECT a, b, c / (na + nb - c) AS jaccard FROM c WHERE c / (na + nb - c) >= 0.8)
"""


@query(_SETS + "SELECT a, b, round(jaccard, 6) AS jaccard FROM p")
def near_dup_pairs(spark, sf_dir):
    pairs, _ = dedup.near_text_pairs(docs_of(spark, sf_dir), "doc_id", ["lang"], "lang")
    return pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(_SETS + """, o AS (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS n FROM p GROUP BY b),
later AS (SELECT b FROM o), walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS gone UNION ALL
 SELECT w.n + 1, CASE WHEN len(list_filter(o.earlier, lambda y: NOT list_contains(w.gone, y))) > 0 THEN list_append(w.gone, o.b) ELSE w.gone END FROM walk w JOIN o ON o.n = w.n + 1),
dropped AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM walk ORDER BY n DESC LIMIT 1))
SELECT id AS doc_id FROM k WHERE id NOT IN (SELECT id FROM dropped) UNION ALL SELECT doc_id FROM documents WHERE text IS NULL""")
def near_dedup_keep(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    gone = dedup.near_dedup(docs, "doc_id", ["lang"], store.materialise, "lang")
    return docs.join(gone, docs["doc_id"] == gone["id"], "left_anti").select("doc_id")


_SPLIT = "CASE doc_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' WHEN 7 THEN 'external' ELSE 'train' END"


@query(rf"""SELECT doc_id, split FROM (SELECT doc_id, {_SPLIT} AS split, row_number() OVER (PARTITION BY regexp_replace(text, '^\s+|\s+$', '', 'g')
 ORDER BY CASE {_SPLIT} WHEN 'external' THEN -1 WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, doc_id) AS n FROM documents) WHERE n = 1 OR split = 'external'""")
def exact_text_dedup(spark, sf_dir):
    m = F.col("doc_id") % 10
    d = docs_of(spark, sf_dir).withColumn("split", F.when(m == 8, "val").when(m == 9, "test").when(m == 7, "external").otherwise("train"))
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    return dedup.dedup_splits(d, rank, F.col("split") == "external", order="doc_id").select("doc_id", "split")


@query("""SELECT doc_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY origin) AS n FROM
 (SELECT doc_id, 0 AS origin FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM documents)) WHERE n = 1""")
def id_dedup_keep_first(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id")
    both = d.where("doc_id % 2 = 0").withColumn("origin", F.lit(0)).unionByName(d.withColumn("origin", F.lit(1)))
    return dedup.keep_first(both, ["doc_id"], ["origin"])


@query(f"SELECT doc_id, {duck_mod(1000, 'doc_id::VARCHAR')}::BIGINT AS m, CASE WHEN {duck_mod(5, 'CONCAT(doc_id, chr(0), lang)')} < 3 THEN 'a' WHEN {duck_mod(5, 'CONCAT(doc_id, chr(0), lang)')} < 4 THEN 'b' ELSE 'c' END AS model FROM documents")
def hash_modulo_pick(spark, sf_dir):
    key = F.col("doc_id")
    return docs_of(spark, sf_dir).select("doc_id", hashing.sha_modulo(1000, key).alias("m"), hashing.weighted_pick([("a", 3), ("b", 1), ("c", 1)], key, F.col("lang")).alias("model"))


@query(f"""WITH d AS (SELECT lang, source, min(CASE WHEN doc_id % 50 = 3 THEN 'external' END) AS inherited, max((doc_id % 97 = 5)::INT) AS held,
 arg_min(CASE WHEN doc_id % 2 = 0 THEN 'val' ELSE 'train' END, doc_id) FILTER (WHERE doc_id % 3 = 2 AND doc_id % 5 = 0) AS tag FROM documents GROUP BY ALL),
h AS (SELECT *, {duck_mod(1000, 'CONCAT(lang, chr(0), source)')} AS m FROM d)
SELECT lang, source, CASE WHEN inherited IS NOT NULL THEN inherited WHEN source = 'src7' THEN 'ood_domain' WHEN held = 1 THEN 'ood_generator' WHEN tag IS NOT NULL THEN tag
 WHEN m < 800 THEN 'train' WHEN m < 900 THEN 'val' ELSE 'test' END AS split FROM h""")
def doc_split_assignment(spark, sf_dir):
    """A document's rows share a split: inherited, held-out domain, held-out model, edit tag, hash."""
    i = F.col("doc_id")
    edit = F.when((i % 3 == 2) & (i % 5 == 0), F.when(i % 2 == 0, "val").otherwise("train"))
    g = docs_of(spark, sf_dir).groupBy("lang", "source").agg(
        F.min(F.when(i % 50 == 3, "external")).alias("inherited"), F.max((i % 97 == 5).cast("int")).alias("held"), F.min_by(edit, F.when(edit.isNotNull(), i)).alias("tag")
    )
    m = hashing.sha_modulo(1000, F.col("lang"), F.col("source"))
    fallback = F.when(m < 800, "train").when(m < 900, "val").otherwise("test")
    split = F.coalesce("inherited", F.when(F.col("source") == "src7", "ood_domain"), F.when(F.col("held") == 1, "ood_generator"), "tag", fallback)
    return g.select("lang", "source", split.alias("split"))


@query(f"""WITH d AS (SELECT doc_id, lang, {_TYPES} || '|' || source AS cell FROM documents WHERE doc_id % 3 <> 0),
t AS (SELECT *, row_number() OVER (PARTITION BY lang, cell ORDER BY sha256(doc_id::VARCHAR) DESC) AS turn FROM d)
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, cell) AS n FROM t) WHERE n <= 60""")
def round_robin_sample(spark, sf_dir):
    d = docs_of(spark, sf_dir).where("doc_id % 3 <> 0").withColumn("text_type", text_type())
    return sampling.round_robin(d, "lang", ["text_type", "source"], "doc_id", 60).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) AS n FROM documents) WHERE n <= 25")
def per_language_first_n(spark, sf_dir):
    return sampling.first_per_group(docs_of(spark, sf_dir), ["lang"], [F.sha2(F.col("doc_id").cast("string"), 256)], 25).select("doc_id", "lang")


_QUOTA = """sizes AS (SELECT s, count(*) AS c FROM base GROUP BY s), q AS (SELECT s, c * {n}.0 / sum(c) OVER () AS x FROM sizes),
q2 AS (SELECT s, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, s) <= {n} - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS q FROM q)"""


@query(f"""WITH base AS (SELECT o_orderkey, o_orderpriority || chr(0) || o_orderstatus AS s FROM orders), {_QUOTA.format(n=333)}
SELECT o_orderkey FROM (SELECT o_orderkey, s, row_number() OVER (PARTITION BY s ORDER BY o_orderkey) AS n FROM base) JOIN q2 USING (s) WHERE n <= q""")
def proportional_sample(spark, sf_dir):
    return sampling.proportional(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 333).select("o_orderkey")


@query(f"""WITH base AS (SELECT l_orderkey, l_returnflag AS s FROM lineitem WHERE l_linenumber = 1), {_QUOTA.format(n=100)},
picked AS (SELECT l_orderkey FROM (SELECT l_orderkey, s, row_number() OVER (PARTITION BY s ORDER BY l_orderkey) AS n FROM base) JOIN q2 USING (s) WHERE n <= q)
SELECT l_orderkey, l_linenumber::INT AS l_linenumber FROM lineitem SEMI JOIN picked USING (l_orderkey)""")
def document_sample_complete(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    first = lines.where("l_linenumber = 1")
    picked = sampling.proportional(first, ["l_returnflag"], "l_orderkey", 100).select("l_orderkey")
    return lines.join(picked, "l_orderkey", "left_semi").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"))


@query(f"""WITH base AS (SELECT conv_id, conv_id * 1000 + turn AS key, (length(text) > 60)::VARCHAR AS s FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1), {_QUOTA.format(n=60)},
picked AS (SELECT conv_id FROM (SELECT conv_id, s, row_number() OVER (PARTITION BY s ORDER BY key) AS n FROM base) JOIN q2 USING (s) WHERE n <= q)
SELECT conv_id, turn FROM conversations SEMI JOIN picked USING (conv_id)""")
def complete_conversations(spark, sf_dir):
    """A sample of conversations by their first turn's length, with all their turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("key"), (F.length("text") > 60).cast("string").alias("long"))
    return sampling.complete_documents(turns, "conv_id", ["long"], "key", 60).select("conv_id", "turn")


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, user_id % 7 ORDER BY event_id) AS n FROM events) WHERE n <= 3")
def topk_per_cell(spark, sf_dir):
    return sampling.first_per_group(table(spark, sf_dir, "events"), ["event_type", F.col("user_id") % 7], ["event_id"], 3).select("event_id", "event_type")


@query("""WITH p AS (SELECT a.vec_id, list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE) AS m,
 list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE) AS aa, list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE) AS bb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, (1 - list_sum(m) / (sqrt(list_sum(aa)) * sqrt(list_sum(bb)))) / 2 AS d FROM p)
SELECT vec_id, round(d, 6) AS magnitude, CASE WHEN d <= 0.4 THEN 0 WHEN d >= 0.6 THEN 3 ELSE least(1 + floor((d - 0.4) / (0.6 - 0.4) * 2), 2) END::INT AS bucket FROM s""")
def edit_magnitude_bucket(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    d = pairs.withColumn("d", (1 - decode.cosine(F.col("embedding"), F.col("other"))) / 2)
    return d.select("vec_id", F.round("d", 6).alias("magnitude"), decode.score_to_bucket(F.col("d"), 4, F.lit(0.4), F.lit(0.6)).alias("bucket"))


@query(f"""WITH s AS (SELECT lang, {_SCORE} AS score FROM documents WHERE doc_id % 3 = 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score) AS r, count(*) OVER (PARTITION BY lang) AS n FROM s)
SELECT lang, round(max(CASE WHEN r = least(n - 1, floor(0.22 * n)) + 1 THEN score END), 9) AS p22, round(max(CASE WHEN r = least(n - 1, floor(0.8 * n)) + 1 THEN score END), 9) AS p80, max(n)::BIGINT AS n FROM r GROUP BY lang""")
def recommended_cuts(spark, sf_dir):
    d = ranking.counted(docs_of(spark, sf_dir).where("doc_id % 3 = 2").select("lang", score().alias("score")), ["lang"], "score")
    total = F.col("n_total")
    at = lambda q: F.round(ranking.at(F.least(total - 1, F.floor(F.lit(q) * total)), "score"), 9)
    return d.groupBy("lang").agg(at(0.22).alias("p22"), at(0.8).alias("p80"), F.max("n_total").alias("n"))


@query(f"""WITH x AS ({_LABELLED}) SELECT a.lang, round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auroc
 FROM x a JOIN x b ON a.lang = b.lang AND a.label = 1 AND b.label = 0 GROUP BY a.lang""")
def auroc_by_group(spark, sf_dir):
    return metrics.auroc(labelled(spark, sf_dir), ["lang"]).where("auroc is not null").select("lang", F.round("auroc", 6).alias("auroc"))


@query(f"""WITH x AS ({_LABELLED}), t AS (SELECT lang, quantile_cont(score, 0.95) AS th FROM x WHERE label = 0 GROUP BY lang),
b AS (SELECT x.lang, avg(CASE WHEN label = 1 THEN (score > th)::INT END) AS gt, avg(CASE WHEN label = 1 THEN (score >= th)::INT END) AS ge FROM x JOIN t USING (lang) GROUP BY x.lang),
c AS (SELECT DISTINCT lang, score AS cut FROM x), s AS (SELECT c.lang, cut, sum((label = 1 AND score >= cut)::INT) / nullif(sum((label = 1)::INT), 0) AS tp, sum((label = 0 AND score >= cut)::INT) / nullif(sum((label = 0)::INT), 0) AS fp FROM c JOIN x USING (lang) GROUP BY c.lang, cut)
SELECT b.lang, round(gt, 6) AS tpr_gt, round(ge, 6) AS tpr_ge, round(coalesce((SELECT max(tp) FROM s WHERE s.lang = b.lang AND fp <= 0.05), 0), 6) AS tpr_stairs FROM b""")
def tpr_at_fpr_variants(spark, sf_dir):
    t = metrics.tpr_variants(labelled(spark, sf_dir), ["lang"], 0.05)
    return t.select("lang", *[F.round(c, 6).alias(c) for c in ("tpr_gt", "tpr_ge", "tpr_stairs")])


@query(f"""WITH x AS ({_LABELLED}), g AS (SELECT i / 999.0 AS t FROM range(1000) r(i)),
f AS (SELECT t, round(coalesce(2.0 * sum((label = 1 AND score >= t - 1e-12)::INT) / nullif(sum((score >= t - 1e-12)::INT) + sum(label), 0), 0), 9) AS f1 FROM g, x GROUP BY t)
SELECT round(t, 6) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, t LIMIT 1""")
def best_threshold(spark, sf_dir):
    return metrics.best_threshold(labelled(spark, sf_dir)).select(F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


@query(f"""WITH x AS ({_LABELLED}), h AS (SELECT lang, score, row_number() OVER (PARTITION BY lang ORDER BY score) AS r, count(*) OVER (PARTITION BY lang) AS n FROM x WHERE label = 0)
SELECT lang, round(coalesce(max(CASE WHEN r = ceil(round((n + 1) * 0.95, 9)) THEN score END), 'inf'::DOUBLE), 9) AS threshold FROM h GROUP BY lang""")
def conformal_by_group(spark, sf_dir):
    return metrics.conformal_threshold(labelled(spark, sf_dir), ["lang"], 0.05).select("lang", F.round("threshold", 9).alias("threshold"))


@query(f"""WITH x0 AS ({_LABELLED}), m AS (SELECT avg(CASE WHEN label = 1 THEN score END) AS m1, avg(CASE WHEN label = 0 THEN score END) AS m0 FROM x0),
x AS (SELECT source AS domain, label, CASE WHEN m0 > m1 THEN -score ELSE score END AS score FROM x0, m), t AS (SELECT domain, quantile_cont(score, 0.95) AS th FROM x WHERE label = 0 GROUP BY domain)
SELECT domain, round(any_value(th), 6) AS threshold, round(avg(CASE WHEN label = 1 THEN (score > th)::INT END), 6) AS tpr, round(avg(CASE WHEN label = 0 THEN (score > th)::INT END), 6) AS fpr
FROM x JOIN t USING (domain) GROUP BY domain HAVING count(*) FILTER (WHERE label = 1) > 0""")
def per_domain_protocol(spark, sf_dir):
    t = metrics.domain_protocol(labelled(spark, sf_dir).withColumnRenamed("source", "domain"), 0.05)
    return t.select("domain", *[F.round(c, 6).alias(c) for c in ("threshold", "tpr", "fpr")])


@query(f"""WITH x AS (SELECT (doc_id % 3)::INT AS t, CASE WHEN {_SCORE} > 0.66 THEN 1 WHEN {_SCORE} < 0.33 THEN 0 ELSE 2 END AS p FROM documents), c AS (SELECT unnest([0, 1, 2]) AS k)
SELECT k::INT AS class, sum((t = k)::INT)::BIGINT AS support, sum((t = k AND p = k)::INT)::BIGINT AS tp, round(2.0 * sum((t = k AND p = k)::INT) / (sum((t = k)::INT) + sum((p = k)::INT)), 6) AS f1 FROM c, x GROUP BY k""")
def ternary_confusion(spark, sf_dir):
    d = docs_of(spark, sf_dir).select((F.col("doc_id") % 3).cast("int").alias("t"), decode.ternary(score(), F.lit(0.33), F.lit(0.66)).alias("p"))
    return metrics.class_f1(d, "t", "p", [0, 1, 2]).select("class", "support", "tp", F.round("f1", 6).alias("f1"))


@query(f"""WITH x AS (SELECT lang, {_TYPES} AS tt, {_SCORE} AS score FROM documents)
SELECT lang, tt AS text_type, count(*)::BIGINT AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median FROM x GROUP BY GROUPING SETS ((), (lang), (tt), (lang, tt))""")
def grouped_metrics(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("lang", text_type().alias("text_type"), score().alias("score"))
    level = lambda k, lang, kind: F.struct(F.lit(k).alias("level"), lang.cast("string").alias("lang"), kind.cast("string").alias("text_type"))
    lang, kind, none = F.col("lang"), F.col("text_type"), F.lit(None)
    levels = F.explode(F.array(level(0, none, none), level(1, lang, none), level(2, none, kind), level(3, lang, kind)))
    v = d.groupBy("lang", "text_type", "score").count().select(levels.alias("g"), "score", "count").select("g.*", "score", "count")
    groups = ["level", "lang", "text_type"]
    v = ranking.running(v.groupBy(*groups, "score").agg(F.sum("count").alias("n")), groups, "score", ["n"])
    mean = F.sum(F.col("score") * F.col("n")) / F.sum("n")
    return v.groupBy(*groups).agg(F.sum("n").alias("n"), F.round(mean, 6).alias("mean"), F.round(ranking.interpolated(0.5, "score"), 6).alias("median")).drop("level")


@query("""WITH x AS (SELECT vec_id, 1 / (1 + exp(-embedding[1]::DOUBLE)) AS a, 1 / (1 + exp(-embedding[2]::DOUBLE)) AS b, 1 / (1 + exp(-embedding[3]::DOUBLE)) AS c FROM embeddings)
SELECT vec_id, round((a + a * b + a * b * c) / 3, 6) AS corn_score, ((a > 0.5)::INT + (a * b > 0.5)::INT + (a * b * c > 0.5)::INT)::INT AS corn_rank, round(a * b - a * b * c, 6) AS p2 FROM x""")
def corn_decode(spark, sf_dir):
    x = F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double"))
    d = table(spark, sf_dir, "embeddings").select("vec_id", decode.corn_cumulative(x).alias("c"))
    return d.select("vec_id", F.round(decode.corn_score(F.col("c")), 6).alias("corn_score"), decode.corn_rank(F.col("c")).alias("corn_rank"), F.round(decode.corn_buckets(F.col("c"))[2], 6).alias("p2"))


@query("""WITH x AS (SELECT vec_id, exp(embedding[1]::DOUBLE) AS a, exp(embedding[2]::DOUBLE) AS b, exp(embedding[3]::DOUBLE) AS c, exp(embedding[4]::DOUBLE) AS d FROM embeddings),
y AS (SELECT vec_id, (b + 2 * c + 3 * d) / (a + b + c + d) / 3 AS s FROM x)
SELECT vec_id, round(s, 6) AS score, CASE WHEN least(greatest((s - 0.4) / (0.6 - 0.4), 0), 1) < 0.4 THEN 0 WHEN least(greatest((s - 0.4) / (0.6 - 0.4), 0), 1) > 0.7 THEN 1 ELSE 2 END::INT AS label FROM y""")
def softmax_decode(spark, sf_dir):
    x = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double"))
    d = table(spark, sf_dir, "embeddings").select("vec_id", decode.expected_rank(decode.softmax(x)).alias("s"))
    return d.select("vec_id", F.round("s", 6).alias("score"), decode.shipped_label(decode.calibrated(F.col("s"), 0.4, 0.6), F.lit(0.4), F.lit(0.7)).alias("label"))


@query(f"""WITH x AS (SELECT lang, {_SCORE} AS a, n_chars::DOUBLE AS b FROM documents), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY a) + (count(*) OVER (PARTITION BY lang, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY lang ORDER BY b) + (count(*) OVER (PARTITION BY lang, b) - 1) / 2.0 AS rb FROM x)
SELECT lang, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(avg(abs(a - b / 40000)), 6) AS mae, round(max(abs(a - b / 40000)), 6) AS max_diff, round(avg(((a > 0.5) = (b > 2000))::INT), 6) AS agree FROM r GROUP BY lang""")
def rank_correlation(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("lang", score().alias("a"), F.col("n_chars").cast("double").alias("b"))
    d = ranking.with_average_rank(ranking.with_average_rank(d, ["lang"], "a", "ra"), ["lang"], "b", "rb")
    gap = F.abs(F.col("a") - F.col("b") / 40000)
    agree = ((F.col("a") > 0.5) == (F.col("b") > 2000)).cast("int")
    return d.groupBy("lang").agg(*[F.round(c, 6).alias(n) for n, c in (("pearson", F.corr("a", "b")), ("spearman", F.corr("ra", "rb")), ("mae", F.avg(gap)), ("max_diff", F.max(gap)), ("agree", F.avg(agree)))])


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), w AS (SELECT lang, n, power(n, -0.5) AS w FROM c)
SELECT lang, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS class_weight, round(w * sum(n) OVER () / sum(n * w) OVER (), 6) AS sample_weight FROM w""")
def class_and_sample_weights(spark, sf_dir):
    c = docs_of(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n")).withColumn("w", F.pow("n", F.lit(-0.5)))
    w = Window.partitionBy()
    return c.select("lang", F.round(F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")), 6).alias("class_weight"), F.round(F.col("w") * F.sum("n").over(w) / F.sum(F.col("n") * F.col("w")).over(w), 6).alias("sample_weight"))


@query("""WITH p(role, price) AS (VALUES ('user', 0.5), ('assistant', 1.5)), t AS (SELECT role, trunc(length(text) / 4.0)::BIGINT AS n FROM conversations)
SELECT t.role, count(*)::BIGINT AS calls, sum(n)::BIGINT AS tokens, round(sum(n) * coalesce(any_value(price), 0) / 1000000, 9) AS cost FROM t LEFT JOIN p USING (role) GROUP BY t.role""")
def cost_by_model(spark, sf_dir):
    prices = spark.createDataFrame([("user", 0.5), ("assistant", 1.5)], "role string, price double")
    t = table(spark, sf_dir, "conversations").select("role", (F.length("text") / 4.0).cast("long").alias("n"))
    return t.join(F.broadcast(prices), "role", "left").groupBy("role").agg(
        F.count("*").alias("calls"), F.sum("n").alias("tokens"), F.round(F.sum("n") * F.coalesce(F.first("price"), F.lit(0.0)) / 1000000, 9).alias("cost")
    )


@query("""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE text <> '') AS passage, count(*)::BIGINT AS turns FROM conversations GROUP BY conv_id""")
def thread_passages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"), F.count("*").alias("turns"))
    passage = F.array_join(F.transform(F.filter("t", lambda x: x["text"] != ""), lambda x: x["text"]), "\n")
    return c.select("conv_id", passage.alias("passage"), "turns")


_ROW = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(rf"""SELECT doc_id, sha256(concat('documents', chr(0), source, chr(0), {_TYPES}, chr(0), sha256({_ROW}), chr(0), doc_id)) AS row_id, sha256({_ROW}) AS text_sha256 FROM documents""")
def release_normalize(spark, sf_dir):
    return _release(spark, sf_dir).select("doc_id", "row_id", "text_sha256")


def _release(spark, sf_dir):
    """Every document, a blank text too; a null is nothing in the identity."""
    d = docs_of(spark, sf_dir).withColumn("text_sha256", F.sha2(textfn.strip(F.col("text")), 256))
    parts = [F.coalesce(c, F.lit("")) for c in (F.col("source"), text_type(), F.col("text_sha256"))]
    return d.withColumn("row_id", hashing.sha_key(F.lit("documents"), *parts, F.col("doc_id")))


@query(rf"""WITH r AS (SELECT sha256(concat('documents', chr(0), source, chr(0), {_TYPES}, chr(0), sha256({_ROW}), chr(0), doc_id)) AS row_id FROM documents)
SELECT count(*)::BIGINT AS n, sha256(string_agg(row_id, chr(10) ORDER BY row_id)) AS rows_sha256 FROM r""")
def snapshot_digest(spark, sf_dir):
    return store.ordered_digest(_release(spark, sf_dir), "row_id", "rows_sha256")


@query("""SELECT 'missing' AS kind, count(*)::BIGINT AS n FROM documents ANTI JOIN labels USING (doc_id) UNION ALL
SELECT 'unexpected', count(*)::BIGINT FROM labels ANTI JOIN documents USING (doc_id) UNION ALL SELECT 'repeated', count(*)::BIGINT FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)""")
def coverage_check(spark, sf_dir):
    d, x = docs_of(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n(d.join(x, "doc_id", "left_anti"), "missing").unionByName(n(x.join(d, "doc_id", "left_anti"), "unexpected")).unionByName(n(x.groupBy("doc_id").count().where("count > 1"), "repeated"))


_DUCK_POISSON = " + ".join(f"(u >= {p})::INT" for p in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183))


@query(f"""WITH x AS ({_LABELLED}), r AS (SELECT x.*, i AS rep, CAST('0x' || substr(md5(i || '|' || source), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM x, range(50) t(i)), w AS (SELECT *, {_DUCK_POISSON} AS w FROM r),
m AS (SELECT rep, sum(w * (label = 1 AND score >= 0.5)::INT) / nullif(sum(w * (label = 1)::INT), 0) AS tpr FROM w WHERE w > 0 GROUP BY rep)
SELECT count(tpr)::BIGINT AS samples, round(quantile_cont(tpr, 0.025), 6) AS low, round(quantile_cont(tpr, 0.975), 6) AS high FROM m""")
def bootstrap_ci(spark, sf_dir):
    """Interval of TPR at 0.5, resampling whole sources."""
    hit = ((F.col("label") == 1) & (F.col("score") >= 0.5)).cast("int")
    m = metrics.bootstrap_sums(labelled(spark, sf_dir), "source", 50, {"hit": hit, "pos": F.col("label")})
    m = metrics.interval(m.withColumn("tpr", metrics.ratio(F.col("hit"), F.col("pos"))), "tpr")
    return m.select("samples", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, line, len(regexp_extract_all(line, '[\p{L}\p{N}_]+')) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM
 (SELECT doc_id, i, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE line <> ''),
w AS (SELECT doc_id, n, s AS size, 0 AS piece FROM l WHERE n = 1 UNION ALL
 SELECT l.doc_id, l.n, CASE WHEN w.size >= 120 THEN l.s ELSE w.size + l.s END, CASE WHEN w.size >= 120 THEN w.piece + 1 ELSE w.piece END FROM w JOIN l ON l.doc_id = w.doc_id AND l.n = w.n + 1)
SELECT doc_id, piece, string_agg(line, chr(10) ORDER BY n) AS passage FROM w JOIN l USING (doc_id, n) GROUP BY doc_id, piece""")
def passage_chunks(spark, sf_dir):
    p = passages.chunks(F.col("text"), textfn.word_count, 120)
    return docs_of(spark, sf_dir).select("doc_id", F.posexplode(p).alias("piece", "passage"))


@query()
def html_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", passages.page_text("html").alias("page")).select("page_id", "page.title", "page.body")


@query(f"SELECT doc_id, {_SCORE} AS score FROM documents")
def resumable_scoring(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    root = store.folder(spark)
    return resumable_scores(spark, f"{sf_dir}/documents.parque[t]", docs.schema, lambda b: b.select("doc_id", score().alias("score")), f"{root}/out", f"{root}/state")


from inkwell.plans import build  # noqa: E402, F401  (it registers a query that is made of those above)

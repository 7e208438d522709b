"""Queries over documents: words, keywords, chunks, relevance, names, the hash embedding, preferences.

The SQL spells out its own word lists and separators, so it doesn't repeat a mistake of the library's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import documents
from .registry import query, table

TERMS = ("the", "and", "queue", "sch", "tion", "des", "idiot", "trash", "ing", "moron")
PHRASE = "the and thing tionor erhe licensed apache version public about"

WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^a-zA-Z0-9'']+'), lambda w: w <> '')"
# Words that are no keywords.
STOP = (
    "['the','and','for','are','but','not','you','all','can','her','was','one','our','out','has','have','had','this','that','with',"
    "'they','from','been','said','each','which','their','will','other','about','many','then','them','these','some','would','into']"
)
KEYS = f"w AS (SELECT doc_id, unnest({WORDS.format('text')}) AS w, generate_subscripts({WORDS.format('text')}, 1) AS i FROM documents), k0 AS (SELECT doc_id, w, min(i) AS i FROM w WHERE length(w) >= 3 AND NOT list_contains({STOP}, w) GROUP BY 1, 2), k AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM k0)"
ASKED = f"q AS (SELECT unnest(string_split('{PHRASE}', ' ')) AS w)"
N = len(PHRASE.split())
BLANK = "'\\n[\\f\\n\\r\\t\\v\\x{85}\\pZ]*\\n'"


@query(f"WITH {KEYS} SELECT doc_id, w AS keyword, r AS place FROM k WHERE r <= 200")
def keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(t.keywords(F.col("text"))).alias("place", "keyword")).select("doc_id", "keyword", (F.col("place") + 1).cast("long").alias("place"))


@query(f"WITH {KEYS}, {ASKED}, h AS (SELECT doc_id, count(*) AS n FROM q JOIN k USING (w) WHERE r <= 200 GROUP BY 1) SELECT doc_id, round(coalesce(n, 0) / {N}, 9) AS overlap FROM documents LEFT JOIN h USING (doc_id)")
def keyword_overlap(spark, d):
    asked = F.array(*map(F.lit, documents.plain_words(PHRASE)))
    return table(spark, d, "documents").select("doc_id", F.round(t.overlap(asked, t.keywords(F.col("text"))), 9).alias("overlap"))


@query("SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9'']+'), lambda w: w <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9'']+'), lambda w: w <> ''), 1) AS place FROM documents")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(t.words(F.col("text"))).alias("place", "word")).select("doc_id", "word", (F.col("place") + 1).cast("long").alias("place"))


def paragraphs(spark, d):
    """Documents with a blank line after each sentence, as the tables hold texts without paragraphs."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))


def chunk_sql(source: str, size: int) -> str:
    """CTEs that end in c(doc, chunk_no, chunk) of source(doc, text)."""
    return f"""pz AS (SELECT doc, CASE WHEN length(text) <= {size} THEN [text] ELSE regexp_split_to_array(text, {BLANK}) END AS p, length(text) <= {size} AS whole FROM {source}),
s AS (SELECT doc, p, whole, 1 AS i, 0 AS no, p[1] AS open FROM pz
UNION ALL SELECT doc, p, whole, i + 1, CASE WHEN length(open) + length(p[i + 1]) > {size} AND open <> '' THEN no + 1 ELSE no END,
CASE WHEN open = '' OR length(open) + length(p[i + 1]) > {size} THEN p[i + 1] ELSE open || chr(10) || chr(10) || p[i + 1] END FROM s WHERE i < len(p)),
c AS (SELECT doc, CAST(no AS INT) AS chunk_no, arg_max(open, i) AS chunk FROM s GROUP BY doc, no HAVING bool_or(whole) OR arg_max(open, i) <> '')"""


@query(f"WITH RECURSIVE d AS (SELECT doc_id AS doc, replace(text, '. ', '.' || chr(10) || chr(10)) AS text FROM documents), {chunk_sql('d', 400)} SELECT * FROM c")
def chunk_texts(spark, d):
    return paragraphs(spark, d).select("doc", F.posexplode(t.chunks(F.col("text"), 400)).alias("chunk_no", "chunk"))


def relevance_sql(source: str, size: int, k: int) -> str:
    return f"""o AS (SELECT doc_id AS doc, count(*) / {N} AS of_doc FROM q JOIN k USING (w) WHERE r <= 200 GROUP BY 1), known AS (SELECT * FROM {source} WHERE doc IN (SELECT doc FROM o)),
{chunk_sql('known', size)}, h AS (SELECT DISTINCT doc, chunk_no, chunk, unnest({WORDS.format('chunk')}) AS w FROM c),
best AS (SELECT doc, chunk_no, chunk, count(*) / {N} AS own FROM h JOIN q USING (w) GROUP BY 1, 2, 3)
SELECT doc, chunk_no, trim(chunk, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS chunk, round(own + 0.3 * of_doc, 9) AS score FROM best JOIN o USING (doc) ORDER BY score DESC, doc, chunk_no LIMIT {k}"""


@query(f"WITH RECURSIVE {KEYS}, {ASKED}, d AS (SELECT doc_id AS doc, text FROM documents), {relevance_sql('d', 300, 10)}")
def relevance(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return documents.relevance(docs, PHRASE, 10)


@query(f"WITH RECURSIVE {KEYS}, {ASKED}, d AS (SELECT doc_id AS doc, replace(text, '. ', '.' || chr(10) || chr(10)) AS text FROM documents), {relevance_sql('d', 300, 50)}")
def chunk_relevance(spark, d):
    return documents.relevance(paragraphs(spark, d), PHRASE, 50)


NAMES = ("Art Prompts {}.txt", "Universe-Notes {}.md", "Glossary_{}.txt", "npc list {}.txt", "Character {}: Öl.md", "location {}.md", "World map #{}.txt", "Notes {}!.txt")


def names(spark, d):
    made = F.element_at(F.array(*(F.concat(F.lit(a), F.col("doc_id").cast("string"), F.lit(b)) for a, b in (n.split("{}") for n in NAMES))), F.pmod("doc_id", F.lit(len(NAMES))).cast("int") + 1)
    return table(spark, d, "documents").select("doc_id", made.alias("name"))


@query(
    "WITH n AS (SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{n.split('{}')[0]}' || doc_id || '{n.split('{}')[1]}'" for i, n in enumerate(NAMES)) + """ END AS name FROM documents)
SELECT doc_id, CASE WHEN contains(lower(name), 'prompt') THEN 'prompts' WHEN regexp_matches(lower(name), 'universe|glossary|lore') THEN 'universe' WHEN regexp_matches(lower(name), 'character|npc') THEN 'characters'
WHEN regexp_matches(lower(name), 'location|place|world') THEN 'locations' ELSE 'reference' END AS role, regexp_replace(replace(lower(name), ' ', '_'), '[^a-z0-9_]', '', 'g') AS safe,
'prompt_' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '_' || regexp_replace(replace(lower(name), ' ', '_'), '[^a-z0-9_]', '', 'g') AS file_name, '<lora:' || name || ':0.8>' AS tag FROM n""")
def roles_and_names(spark, d):
    name = F.col("name")
    return names(spark, d).select("doc_id", t.role(name).alias("role"), t.safe_name(name).alias("safe"), t.prompt_file_name(F.col("doc_id") % 100, name).alias("file_name"), t.lora_tag(name, F.lit(0.8)).alias("tag"))


@query("""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\\pL\\pM\\pN\\p{Pc}]+')) AS noun, generate_subscripts(regexp_split_to_array(text, '[^\\pL\\pM\\pN\\p{Pc}]+'), 1) AS i FROM documents),
f AS (SELECT doc_id, noun, min(i) AS i FROM p WHERE noun IN ('Apache', 'Creative', 'Public', 'License', 'The', 'Les', 'Der') GROUP BY 1, 2)
SELECT doc_id, noun, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM f""")
def proper_nouns(spark, d):
    found = t.proper_nouns(F.col("text"), ["Apache", "Creative", "Public", "License", "The", "Les", "Der"])
    return table(spark, d, "documents").select("doc_id", F.posexplode(found).alias("place", "noun")).select("doc_id", "noun", (F.col("place") + 1).cast("long").alias("place"))


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\n\\r\\t.,(){}\\[\\];:<>=/*+!?"''\\\\-]'), lambda w: w <> '')) AS w FROM documents),
h AS (SELECT doc_id, list_reduce(list_prepend(CAST(5381 AS BIGINT), [CAST(unicode(c) AS BIGINT) for c in string_split(w, '')]), lambda a, x: xor(a * 33, x) & 4294967295) AS h FROM w),
e AS (SELECT doc_id, CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 768 AS INT) AS d, 1000000 * count(*) AS v FROM h GROUP BY 1, 2)
SELECT doc_id, d, v FROM e UNION ALL SELECT doc_id, 0, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM e)""")
def hash_embedding(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return t.hash_embedding(docs).select("doc_id", F.explode("e").alias("x")).select("doc_id", "x.d", "x.v")


@query("WITH s AS (SELECT lower(text) AS text, CASE WHEN quality = 1 THEN 1.0 ELSE -1.0 END AS w FROM labels JOIN documents USING (doc_id)), t AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in TERMS) + "]) AS term) SELECT term, CAST(sum(w) AS DOUBLE) AS weight FROM s JOIN t ON contains(text, term) GROUP BY term")
def preference_weights(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("text", F.when(F.col("quality") == 1, 1.0).otherwise(-1.0).alias("sign"), F.lit(1.0).alias("strength"))
    return documents.preference_weights(s, list(TERMS))


PROMPTS = ("a wide painterly poster", "dark cinematic portrait, sharp", "solo landscape 16:9 high detail", "soft warm blurry anime", "bold geometric concept art", "still blue purple amber")
SIGNALS = "s AS (SELECT CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PROMPTS)) + " END AS text, CASE WHEN quality = 1 AND doc_id % 5 <> 0 THEN 1.0 ELSE -1.0 END AS sign, 1.0 + doc_id % 3 AS strength, CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'fine' ELSE 'rough' END AS preset FROM labels)"
# Style words that preference signals are read from.
STYLE = (
    "anime|realistic|painterly|cinematic|wide|close-up|bold|dark|bright|saturated|desaturated|detailed|minimal|dramatic|soft|hard|warm|cool|purple|amber|copper|blue|motion|still|crowds|solo|scale contrast|"
    "geometric|organic|kubrick|easley|moebius|studio khara|concept art|paperback|poster|portrait|landscape|16:9|3:2|1:1|high detail|low detail|sharp|blurry"
)
WEIGHTS = SIGNALS + f", t AS (SELECT unnest(string_split('{STYLE}', '|')) AS term), w AS (SELECT term, sum(sign * strength) AS weight FROM s JOIN t ON contains(text, term) GROUP BY 1 UNION ALL SELECT 'preset:' || preset, sum(strength * 0.5) FROM s WHERE sign > 0 AND preset <> 'none' GROUP BY 1)"


def signals(spark, d):
    n = F.col("doc_id")
    text = F.element_at(F.array(*map(F.lit, PROMPTS)), (n % 6).cast("int") + 1)
    preset = F.when(n % 4 == 0, "none").when(n % 4 == 1, "fine").otherwise("rough")
    return table(spark, d, "labels").select(text.alias("text"), F.when((F.col("quality") == 1) & (n % 5 != 0), 1.0).otherwise(-1.0).alias("sign"), (n % 3 + 1.0).alias("strength"), preset.alias("preset"))


@query(f"WITH {WEIGHTS} SELECT term, CAST(weight AS DOUBLE) AS weight FROM w")
def signal_weights(spark, d):
    return documents.signal_weights(signals(spark, d))


@query(f"WITH {WEIGHTS}, p AS (SELECT CASE WHEN weight > 0 THEN 'like' ELSE 'dislike' END AS side, term, weight FROM w WHERE weight <> 0 AND NOT starts_with(term, 'preset:')), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(weight) DESC, term) AS place FROM p) SELECT side, CAST(place AS INT) AS place, term, CAST(weight AS DOUBLE) AS weight FROM r WHERE place <= 5")
def top_preferences(spark, d):
    return documents.top_preferences(documents.signal_weights(signals(spark, d)))


@query(f"WITH {WEIGHTS} SELECT coalesce((SELECT substr(term, 8) FROM w WHERE starts_with(term, 'preset:') AND weight > 0 ORDER BY weight DESC, term LIMIT 1), 'none') AS preset")
def suggested_preset(spark, d):
    return documents.suggested_preset(documents.signal_weights(signals(spark, d)))


@query("""WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), f AS (SELECT doc_id, l FROM p WHERE len(l) >= 2)
SELECT CAST(doc_id AS VARCHAR) AS file, CAST(doc_id % 90 AS INT) AS number, source AS title, 'part ' || lang AS series, trim(l[1], ' ' || chr(9) || chr(13)) AS scene, trim(l[2], ' ' || chr(9) || chr(13)) AS style, CASE WHEN doc_id % 2 = 0 THEN 'ink' END AS lora, CAST(CASE WHEN doc_id % 2 = 0 THEN 0.6 ELSE 0.8 END AS DOUBLE) AS lora_weight FROM f JOIN documents USING (doc_id)""")
def prompt_files(spark, d):
    docs = table(spark, d, "documents").withColumn("l", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).filter(F.size("l") >= 2)
    head = [F.lit("an opening line"), F.concat(F.lit("SERIES ONE: part "), "lang"), F.concat(F.lit("PROMPT "), (F.col("doc_id") % 90).cast("string"), F.lit(' — "'), "source", F.lit('"')), F.col("l")[0], F.lit(""), F.col("l")[1]]
    lines = F.concat(F.array(*head), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("LORA: ink:0.6"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("PRODUCTION NOTES"), F.lit("not of the prompt")))
    rows = docs.select(F.col("doc_id").cast("string").alias("file"), F.posexplode(lines).alias("n", "line"))
    return documents.prompts(rows).drop("body")

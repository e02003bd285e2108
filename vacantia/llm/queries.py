"""The registered queries of the training-data operators, and their oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, fingerprints, langid, lexical, line_dedup, packing, pii, quality, simhash, suffix_dedup, token_files, topk
from .common import session

QUERIES, ORACLES = {}, {}


def vocabulary(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(oracle: str | None = None):
    """Register the decorated function (tables reader, folder) under its name."""

    def wrap(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session(spark)
            return plan(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[plan.__name__] = run
        if oracle:
            ORACLES[plan.__name__] = oracle
        return plan

    return wrap


@query(r"""
with lines as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
keyed as (
  select doc_id, list_transform(l, lambda x: translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as k, l from lines),
frequent as (
  select key from (select doc_id, unnest(list_distinct(k)) as key from keyed) where key <> '' group by key having count(*) >= 10),
placed as (
  select doc_id, unnest(k) as key, unnest(l) as line, unnest(range(len(l))) as pos from keyed),
marked as (
  select p.doc_id, line, pos, f.key is not null as gone from placed p left join frequent f on p.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
""")
def op1_line_dedup(table) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    out = line_dedup.dedup_lines(table("documents"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op2_packing(table) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    out = packing.pack(table("documents"), vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op3_suffix_dedup(table) -> DataFrame:
    """Every document without the 400-byte strings that stand more than once; U+FFFD where a cut parts a character of ``text``."""
    out = suffix_dedup.dedup(table("documents"), length=400, keep=["doc_id"])
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))


@query(r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
scores as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q, v c where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score
from scores qualify rank <= 10
""")
def op4_topk(table) -> DataFrame:
    """The ten best vectors of every hundredth vector."""
    vectors = table("embeddings").select("vec_id", topk.quantised("embedding", 1024).alias("vector"))
    return topk.search(vectors.filter("vec_id % 100 = 0"), vectors, k=10, id_col="vec_id", vector_col="vector")


#: stands for the secret that a deployment keeps; whoever has it can undo the permutations
PSEUDONYM_KEY = "vacantia-demo-key"


@query()
def op5_pii(table) -> DataFrame:
    """Every document with pseudonyms in place of personal data."""
    return pii.pseudonymise(table("documents").select("doc_id", "text"), PSEUDONYM_KEY)


@query()
def op6_langid(table) -> DataFrame:
    """Predicted language of every document."""
    docs = table("documents")
    out = langid.identify(docs, langid.fit(docs), keep=["doc_id"])
    return out.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query()
def op7_token_files(table) -> DataFrame:
    """Ids of every document, written to files in order of documents and read back."""
    manifest, folder = token_files.write_tokens(table("documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    out = token_files.read_tokens(manifest, folder)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op8_simhash(table) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.clusters(table("documents"), shingle=3, most=3)


@query()
def op9_bpe(table) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    out = bpe.encode_decode(table("documents"), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op10_quality(table) -> DataFrame:
    """Measures, base rule and verdict of every document."""
    out = quality.judge(table("documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query()
def op11_alignment(table) -> DataFrame:
    """How the tokens of two tokenizers share the bytes of every document."""
    out = alignment.align(table("documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


_PIECES = r"""flatten(list_transform(string_split(replace(replace(replace(replace({text},
    '. ', '. ' || chr(10)), '! ', '! ' || chr(10)), '? ', '? ' || chr(10)), '。', '。' || chr(10)), chr(10)),
    lambda p: case when length(p) > 256 then regexp_extract_all(p, '(?s).{{1,256}}') else [p] end))"""
_LANES = """list_transform(range(128), lambda l: ((2 * list_sum(list_transform({words}, lambda h:
    (h[(l // 32 + 1)::bigint] >> (l % 32)) & 1)) - len({words})) % 65536 + 65536)::bigint % 65536)"""
_WORDS = """list_transform({pieces}, lambda p: list_transform(range(4), lambda k:
    ('0x' || sha256(p)[(8 * k + 1)::bigint:(8 * k + 8)::bigint])::bigint))"""
_LIKE = """case when {a} = {b} then 1.0::double else greatest(0.0::double, least(1.0::double,
    (2 * list_sum(list_transform(range(1, 129), lambda i: {sa} * {sb})))::double
    / list_sum(list_transform(range(1, 129), lambda i: {sa} * {sa} + {sb} * {sb}))::double)) end"""


def _likeness_sql(a: str, b: str) -> str:
    signed = lambda x: f"(({x}[i] + 32768) % 65536 - 32768)::bigint"
    return _LIKE.format(a=a, b=b, sa=signed(a), sb=signed(b))


@query(f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
followed as (
  select doc_id, text, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as next_text from docs),
edited as (
  select *, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) as new_text from followed),
hashed as (
  select *, {_WORDS.format(pieces=_PIECES.format(text='text'))} as w, {_WORDS.format(pieces=_PIECES.format(text='new_text'))} as nw from edited),
summed as (select *, {_LANES.format(words='w')} as a, {_LANES.format(words='nw')} as e from hashed),
beside as (
  select *, coalesce(lead(a) over (order by doc_id), first_value(a) over (order by doc_id)) as b from summed)
select doc_id, length(text) as n_chars, sha256(new_text) as edited_sha256,
  array_to_string(list_transform(a, lambda x: lower(lpad(to_hex(x), 4, '0'))), '') as fingerprint,
  array_to_string(list_transform(e, lambda x: lower(lpad(to_hex(x), 4, '0'))), '') as edited_fingerprint,
  {_likeness_sql('a', 'e')} as near_edited, {_likeness_sql('a', 'b')} as near_next
from beside
""")
def op12_fingerprints(table) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near they are."""
    out = fingerprints.with_edits(table("documents"))
    like = lambda other: fingerprints.likeness(F.col("lanes"), F.col(other))
    return out.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
                      fingerprints.spelled(F.col("lanes")).alias("fingerprint"),
                      fingerprints.spelled(F.col("edited_lanes")).alias("edited_fingerprint"),
                      like("edited_lanes").alias("near_edited"), like("next_lanes").alias("near_next"))


@query(r"""
with words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
asked as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
sums as (select count(*)::bigint as n_docs, sum(len(t))::bigint as total from words where len(t) > 0),
counted as (
  select doc_id, term, count(*)::bigint as tf, any_value(n)::bigint as n
  from (select doc_id, len(t) as n, unnest(t) as term from words) group by doc_id, term),
weights as (
  select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from counted, sums group by term),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::bigint as score
  from asked join counted using (term) join weights using (term), sums group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score
from scored where score > 0 qualify rank <= 10
""")
def op13_lexical_search(table) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(table("benchmark"), lexical.index(table("documents")), k=10)

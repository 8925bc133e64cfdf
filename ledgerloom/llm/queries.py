"""The operators as queries over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontam, divergence, langid, licenses, packing, pivots, sharding, simhash, substrings, toxicity, warc, whitening
from .common import fold, ship_package, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~fold("doc_id", 1, 3)))
    return langid.predict(docs, model).select("doc_id", fold("doc_id", 1, 3).alias("held_out"), "lang_pred", "score")


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(warc.write_archives(table(spark, sf_dir, "pages")))


def op4_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find_occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.fit(docs, labels.where(~fold("doc_id", 0, 5)))
    return toxicity.predict(docs, net).select("doc_id", fold("doc_id", 0, 5).alias("held_out"), "score", "predicted")


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.label_documents(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, radius=2)


def op8_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), window=50)


def op9_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=2)


def op10_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op11_subspace_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=32)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=3, most_terms=200)


def op13_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _ready(f):
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    return call


def queries() -> dict:
    own = [op1_minimax_sharding, op2_language_id, op3_warc_zip, op4_wu_manber, op5_toxicity_cnn, op6_license_rules, op7_simhash, op8_suffix_trees, op9_shortest_pack_first, op10_multi_index_hashing, op11_subspace_whitening, op12_source_divergence, op13_pivot_permutations, pipeline]
    return {f.__name__: _ready(f) for f in own}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p group by d)
select p.page_id, strlen(p.html)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(p.d, (5 * (i // 4) + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '') as payload_digest,
  case when p.page_id = f.first then 'response' else 'revisit' end as record_type,
  case when p.page_id = f.first then null else f.first end as refers_to
from p join f using (d)
"""

OP4_SQL = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
win as (select distinct item_id, array_to_string(w[i:i + 9], ' ') as g, least(len(w), 10) as m
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct m from win),
pos as (select rid, w, m, unnest(range(1, len(w) - m + 2)) as i from d, sizes where len(w) >= m),
occ as (select p.rid, p.i, p.m, win.item_id from pos p join win on win.m = p.m and win.g = array_to_string(p.w[p.i:p.i + p.m - 1], ' ')),
hit as (select rid, count(distinct k) as n_hit from (select rid, unnest(range(i, i + m)) as k from occ) group by rid),
items as (select rid, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct rid, item_id::varchar as x from occ) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rid) left join items using (rid)
"""

OP8_SQL = """
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
win as (select rid, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) as g from (select rid, doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
first as (select g, min(doc_id) as o from win group by g),
gone as (select rid, list(distinct k) as ks from (select win.rid, unnest(range(i, i + 50)) as k from win join first using (g) where first.o < win.doc_id) group by rid),
kept as (select rid, count(*) as n, string_agg(x, ' ' order by k) as t from (select rid, unnest(w) as x, unnest(range(1, len(w) + 1)) as k from d) a
  where not exists (select 1 from (select rid, unnest(ks) as k from gone) g where g.rid = a.rid and g.k = a.k) group by rid)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (rid)
"""

OP12_SQL = """
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
g as (select distinct lang, source from d),
o as (select rid, lang, source, unnest(w) as t from d),
c as (select lang, source, t, count(*) as c, count(distinct rid) as r from o group by all),
k as (select lang, t, sum(c) as c from c group by all having sum(r) >= 3),
v as (select lang, count(*) as v, sum(c) as n from k group by lang),
n as (select g.lang, g.source, coalesce(sum(c.c), 0) as n from g left join (select c.* from c join k using (lang, t)) c using (lang, source) group by all),
p as (select n.lang, n.source, k.t, coalesce(c.c, 0)::hugeint as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 1)) // (n.n + v.v)::hugeint as p
  from n join k using (lang) join v using (lang) left join c on c.lang = n.lang and c.source = n.source and c.t = k.t),
q as (select k.lang, k.t, 1 + (1000000000::hugeint * (k.c::hugeint + 1)) // (v.n + v.v)::hugeint as q from k join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, coalesce(f, 0) as value from g a join g b on a.lang = b.lang and a.source != b.source
  left join (select x.lang, x.source, y.source as o, sum(((x.p - y.p) * (x.p - y.p)) // y.p) as f from p x join p y on x.lang = y.lang and x.t = y.t and x.source != y.source group by all) f
  on f.lang = a.lang and f.source = a.source and f.o = b.source),
terms as (select p.lang, p.source, p.t as item, ((p - q) * (p - q)) // q as value from p join q using (lang, t) where c > 0 and p > q),
r as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) as rank from terms)
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_zip": OP3_SQL, "op4_wu_manber": OP4_SQL, "op8_suffix_trees": OP8_SQL, "op12_source_divergence": OP12_SQL}

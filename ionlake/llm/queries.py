"""The registered queries of this subpackage: each operator over its whole table, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontamination, divergence, language, licenses, mixing, ngram_join, prefix_trie, spotsigs, token_store, toxicity, url_filter
from .shared import read

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def held_out(key: str, mod: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_store(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)
    out = token_store.read_store(manifest)
    return out.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = language.learn_profiles(docs, where=~held_out("k", 4, 2))
    out = language.identify(docs, profiles)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), where=~held_out("doc_id", 3, 1))
    out = toxicity.score_documents(docs, model)
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.json")
    out = bpe.encode_and_decode(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    text = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).documents


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(read(spark, sf_dir, "documents"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_neighbours(read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.concat_ws(",", "licenses").alias("licenses"), F.size("licenses").alias("n_licenses"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(prefix_trie.share_heads(prefix_trie.sequences(read(spark, sf_dir, "conversations"))))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_token_store": op1_token_store,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_url_filter": op6_url_filter,
    "op7_ann": op7_ann,
    "op8_ngram_join": op8_ngram_join,
    "op9_spotsigs": op9_spotsigs,
    "op10_license_scan": op10_license_scan,
    "op11_divergence": op11_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_decontamination": op13_decontamination,
}

ORACLES: dict[str, str] = {
    "op6_url_filter": r"""
with cut as (
  select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
hosts as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw_host from cut),
parts as (
  select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from hosts),
rules(rule_host, rule_path, verdict) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best as (
  select p.page_id, arg_max(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) as rule,
         arg_max(r.verdict, length(r.rule_host || r.rule_path)) as verdict
  from parts p join rules r
    on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path)
  group by p.page_id)
select coalesce(p.page_id, null) as page_id, coalesce(p.host, '') as host, coalesce(p.path, '') as path, b.rule, coalesce(b.verdict, 'allow') as verdict
from parts p left join best b on p.page_id = b.page_id
""",
    "op11_divergence": r"""
with d as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
words as (
  select rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from words group by lang, term having count(distinct rid) >= 10),
groups as (select distinct lang, source from d),
counted as (select lang, source, term, count(*) as n from words group by all),
cells as (
  select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n
  from groups g join kept k on g.lang = k.lang left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term),
v as (select lang, count(*)::hugeint as v from kept group by lang),
totals as (select lang, source, sum(n) as total from cells group by all),
p as (
  select c.lang, c.source, c.term, c.n, 1 + (1000000000::hugeint * (c.n + 2)) // (t.total + 2 * v.v)::hugeint as p
  from cells c join totals t on c.lang = t.lang and c.source = t.source join v on v.lang = c.lang),
whole as (select lang, term, sum(n)::hugeint as n from cells group by all),
wholes as (select lang, sum(n) as total from whole group by lang),
q as (
  select w.lang, w.term, 1 + (1000000000::hugeint * (w.n + 2)) // (t.total + 2 * v.v)::hugeint as q
  from whole w join wholes t on w.lang = t.lang join v on v.lang = w.lang),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source
  left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all),
terms as (
  select p.lang, p.source, p.term as item, ((p.p - q.q) * (p.p - q.q) // (p.p + q.q))::bigint as value
  from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all
select * from (
  select lang, source, 'term' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from terms)
where rank <= 10
""",
    "op12_prefix_trie": r"""
with t as (
  select conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] as id,
         length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as words
  from conversations where conv_id is not null),
own as (select *, row_number() over (partition by conv_id order by turn nulls first, id, words) - 1 as at from t),
table_(i, v) as (
  with recursive r(i, k, v) as (
    select i, 0, i::bigint from range(256) x(i)
    union all
    select i, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from r where k < 8)
  select i, v from r where k = 8),
convs as (
  select c.conv_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(str_split(c.conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
           lambda a, x: xor(a // 256, l.v[xor(a % 256, x) + 1])), 4294967295) % 4 as h
  from (select distinct conv_id from t) c cross join (select list(v order by i) as v from table_) l),
rebuilt as (
  select c.conv_id, o.id, o.words, row_number() over (partition by c.conv_id order by s.part, o.at) as d
  from convs c cross join (values (0), (1)) s(part)
  join own o on (s.part = 0 and o.conv_id = c.conv_id - c.conv_id % 20 and o.at < c.h) or (s.part = 1 and o.conv_id = c.conv_id and o.at >= c.h)),
prefixes as (
  select conv_id, d, words, sha256(string_agg(id, ',') over (partition by conv_id order by d rows unbounded preceding)) as key from rebuilt
  union all select conv_id, 0, 0, '' from convs),
member as (
  select conv_id, d, words, min(conv_id) over (partition by d, key) as node, max(d) over (partition by conv_id) as last from prefixes),
nodes as (select node, d, count(*) as n, min(words) as words from member group by all),
owned as (
  select n.node, n.d, n.n, n.words, m.node as parent
  from nodes n left join member m on m.conv_id = n.node and m.d = n.d - 1),
kids as (select parent as node, d - 1 as d, count(*) as kids from owned where d > 0 group by all),
full_ as (
  select o.*, coalesce(k.kids, 0) as kids from owned o left join kids k on k.node = o.node and k.d = o.d),
under as (
  select m.node, m.d, sum((f.kids = 0)::bigint) as leaves, sum((f.n - 1) * f.words) as saved
  from full_ f join member m on m.conv_id = f.node and m.d <= f.d group by all),
ends as (select node, d, string_agg(conv_id::varchar, ',' order by conv_id) as ids from member where d = last group by all)
select f.node as conv_id, f.d::bigint as depth, f.parent as parent_conv_id, f.n::bigint as n_convs, f.kids::bigint as n_children,
       u.leaves::bigint as n_leaves, u.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from full_ f join under u on u.node = f.node and u.d = f.d left join ends e on e.node = f.node and e.d = f.d
""",
    "op13_decontamination": r"""
with d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (
  select item_id, least(len(w), 10) as l, w, unnest(range(len(w) - least(len(w), 10) + 1)) as s from b where len(w) > 0),
win as (select distinct item_id, l, array_to_string(w[s + 1 : s + l], ' ') as g from bw),
dw as (
  select rid, l, w, unnest(range(greatest(len(w) - l + 1, 0))) as s from d cross join (select distinct l from win)),
hits as (
  select dw.rid, dw.s, dw.l, win.item_id from (select rid, s, l, array_to_string(w[s + 1 : s + l], ' ') as g from dw) dw join win on dw.g = win.g and dw.l = win.l),
reached as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + l)) as p from (select distinct rid, s, l from hits)) group by rid),
items as (select rid, count(*) as n, string_agg(i, ',' order by i) as ids from (select distinct rid, item_id::varchar as i from hits where item_id is not null) group by rid)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(reached.n_hit, 0)::bigint as n_hit, coalesce(items.n, 0)::bigint as n_items,
       sha256(coalesce(items.ids, '')) as items_sha256, coalesce(reached.n_hit, 0) > 0 as contaminated
from d left join reached on reached.rid = d.rid left join items on items.rid = d.rid
""",
}

"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import decontaminate, fingerprints, jaccard, language, licenses, merkle, mixing, pii, substrings, tokens, topk, toxicity, tries
from wattloom.llm.common import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"), 5, 0)
    model = language.learn(docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & ~held))
    scored = language.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_digests(tokens.write_tokens(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = mixing.with_keys(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return mixing.mix(keyed).select("doc_id", "size", "source_size", "target", "taken")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """The model that labels outside the held-out ids give."""
    labels = table(spark, sf_dir, "labels").filter(~language.held_out(F.col("doc_id"), 4, 2))
    return toxicity.learn(docs, labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", language.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
with v as (
  select vec_id, [floor(256 * x::double)::bigint for x in embedding] as v, row_number() over () as r from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
p as (
  select q.vec_id as query_id, c.vec_id, q.r, c.r as cr, list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)])::bigint as score
  from v q join v c on q.r <> c.r and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id, cr) as rank from p) where rank <= 5
"""


OP5_SQL = r"""
with w as materialized (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select r, i, array_to_string(w[i:i + 34], ' ') as x from (select r, w, unnest(range(1, len(w) - 33)) as i from w)),
c as materialized (
  select distinct r, i + k as p from s join (select x from s group by x having count(*) > 1) using (x), (select unnest(range(0, 35)) as k)),
k as (select u.r, string_agg(u.x, ' ' order by u.p) as t, count(*) as n
  from (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from w) u anti join c on c.r = u.r and c.p = u.p group by u.r)
select w.doc_id, len(w.w)::bigint as n_words, (len(w.w) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from w left join k using (r)
"""

OP4_SQL = r"""
with d as (
  select doc_id, source, coalesce(text, '') as t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
k as (
  select *, -ln((cast(('0x' || substr(md5('mix-1|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(t)), 1, 13)) as bigint) + 0.5) / 4503599627370496.0)
    / (case when size >= 5 and length(t) / size between 3.0 and 12.0 then 1.0 else 0.5 end) as key from d),
s as (
  select source, sum(size)::double as s, [5.0, 2.0, 1.0][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)]::double as w from k group by source),
l as (
  select *, (1.5 * sum(s) over () - coalesce(sum(2 * s) over (order by 2 * s / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by 2 * s / w, source nulls last rows between current row and unbounded following) as level from s),
g as (
  select source, s, round(least(w * coalesce(max(case when level <= 2 * s / w then level end) over (), 0), 2 * s), 6) as target from l),
e as (select *, case when s > 0 then floor(target / s) else 0 end as epochs from g),
r as (
  select k.doc_id, k.size, e.s, e.target, e.epochs, e.target - e.epochs * e.s as rest,
    coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from k join e on k.source is not distinct from e.source)
select doc_id, size::bigint as size, s::bigint as source_size, target,
  (size * (epochs + case when before < rest and before + size / 2 <= rest then 1 else 0 end))::bigint as taken from r
"""

OP10_SQL = r"""
with recursive w as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as s from w),
t as materialized (select r, len(s) as n, unnest(s) as x from s),
e as materialized (
  select a.r as a, b.r as b from t a join t b on a.x = b.x and a.r <> b.r group by a.r, b.r, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select r, r as o from s union select reach.r, e.b from reach join e on reach.o = e.a)
select s.doc_id, len(s.s)::bigint as n_shingles, min(o.doc_id) as component_id
from s join reach on reach.r = s.r join s o on o.r = reach.o group by s.r, s.doc_id, s.s
"""

# crc32 of a text of digits, which DuckDB does not have
_CRC = """xor(list_reduce(list_prepend(4294967295, [unicode(x)::bigint for x in string_split(TEXT, '')]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)), 4294967295)"""

OP11_SQL = r"""
with t as materialized (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, s) - 1 as p, s, w from (
    select conv_id, turn, sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as s,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as w
    from conversations where conv_id is not null)),
c as materialized (select conv_id, conv_id - conv_id % 20 as f, CRC % 4 as h from (select distinct conv_id from t)),
k as materialized (select c.*, least(c.h, (select count(*) from t where t.conv_id = c.f)) as k from c),
r as materialized (
  select k.conv_id, t.p, s, w from k join t on t.conv_id = k.f and t.p < k.k
  union all select k.conv_id, t.p - k.h + k.k, s, w from k join t on t.conv_id = k.conv_id and t.p >= k.h),
m as materialized (
  select conv_id, p + 1 as d, sha256(string_agg(s, '') over (partition by conv_id order by p)) as name, w from r
  union all select conv_id, 0, 'root', 0 from c),
l as materialized (select conv_id, max(d) as n from m group by conv_id),
n as materialized (select d, name, min(conv_id) as conv_id, count(*) as n_convs, max(w) as w from m group by d, name),
e as materialized (
  select m.name, sha256(string_agg(l.conv_id::varchar, ',' order by l.conv_id)) as ends from l join m on m.conv_id = l.conv_id and m.d = l.n group by m.name),
x as materialized (select n.*, q.name as up, q.conv_id as q from n left join m a on a.conv_id = n.conv_id and a.d = n.d - 1 left join n q on q.name = a.name),
h as materialized (select up as name, count(*) as n from x where up is not null group by up),
s as (
  select a.name, sum(case when h.n is null then 1 else 0 end) as leaves, sum((n.n_convs - 1) * n.w) as saved
  from n left join h on h.name = n.name join m a on a.conv_id = n.conv_id and a.d <= n.d group by a.name)
select x.conv_id::bigint as conv_id, x.d::bigint as depth, x.q::bigint as parent_conv_id, x.n_convs::bigint as n_convs, coalesce(h.n, 0)::bigint as n_children,
  s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256
from x join s on s.name = x.name left join h on h.name = x.name left join e on e.name = x.name
""".replace("CRC", _CRC.replace("TEXT", "conv_id::varchar"))

_LEAF = "sha256(" + " || ".join(
    f"coalesce(strlen({c})::varchar || ':' || {c}, '-')" for c in ("doc_id::varchar", "source", "lang", "N::varchar", "text")
) + ")"

# levels of a tree: n nodes of a group at each, until one is left
_LEVELS = """
{0} as (
  select 0 as l, g, p, n, h from {1}
  union all select l + 1, g, p // 2, (n + 1) // 2, sha256(string_agg(h, '' order by p)) from {0} where n > 1 group by l, g, p // 2, n)"""

OP12_SQL = (
    "with recursive d as materialized (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as p, count(*) over (partition by g) as n from ("
    "select doc_id, coalesce('=' || lang, '-') as g, row_number() over () as r, "
    + _LEAF.replace("N::varchar", "n_chars::varchar")
    + " as leaf, case when coalesce("
    + _CRC.replace("TEXT", "coalesce(doc_id, 0)::varchar")
    + " % 7 = 0 and doc_id is not null, false) then "
    + _LEAF.replace("N::varchar", "(n_chars + 1)::varchar")
    + " end as changed from documents)),\nb as (select g, p, n, leaf as h from d),"
    + _LEVELS.format("t", "b")
    + ",\nsub as materialized (select g, h from t where n = 1),"
    + "\ntop as materialized (select '' as g, row_number() over (order by g) - 1 as p, count(*) over () as n, h, g as name from sub),"
    + _LEVELS.format("u", "top")
    + """,
ts as materialized (select * from t), us as materialized (select * from u),
-- a row's way: its ancestors' places and, but for the last, their siblings
way as (
  select d.r, x.l, d.p >> x.l as place, y.h as sib, x.n from d join (select distinct g, l, n from ts) x on x.g = d.g and x.n > 1
    left join ts y on y.g = d.g and y.l = x.l and y.p = xor(d.p >> x.l, 1)
  union all
  select d.r, 1000 + x.l, top.p >> x.l, y.h, x.n from d join top on top.name = d.g join (select distinct l, n from us) x on x.n > 1
    left join us y on y.l = x.l and y.p = xor(top.p >> x.l, 1)),
ways as materialized (select r, list({'place': place, 'sib': sib} order by l) as w, coalesce(string_agg(sib, '' order by l), '') as proof from way group by r),
f as (
  select d.*, coalesce(ways.w, []) as w, coalesce(ways.proof, '') as proof,
    list_reduce(list_prepend({'place': 0::bigint, 'sib': coalesce(changed, leaf)}, coalesce(ways.w, [])),
      lambda a, b: {'place': 0::bigint, 'sib': sha256(case when b.sib is null then a.sib when b.place % 2 = 1 then b.sib || a.sib else a.sib || b.sib end)}).sib as folded
  from d left join ways using (r))
select doc_id, leaf, sub.h as subroot, (select h from us where n = 1) as root, sha256(proof) as proof_sha256, folded as folded_root,
  folded = (select h from us where n = 1) as verified
from f join sub on sub.g = f.g
"""
)

QUERIES = {
    f.__name__: f
    for f in (
        op1_language, op2_pii, op3_tokens, op4_mixing, op5_substrings, op6_toxicity, op7_topk, op8_decontaminate, op9_licenses, op10_jaccard,
        op11_tries, op12_merkle, op13_fingerprints,
    )
}
ORACLES = {"op4_mixing": OP4_SQL, "op5_substrings": OP5_SQL, "op7_topk": OP7_SQL, "op10_jaccard": OP10_SQL, "op11_tries": OP11_SQL, "op12_merkle": OP12_SQL}

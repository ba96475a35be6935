"""The queries of this subpackage, one for each operator over its whole table, and the SQL for those that have it."""

from __future__ import annotations

from shoal.llm import decontamination, exact_dedup, html_extract, language_id, line_dedup, mixing, ngram_join, phrases, pivot_clusters, sharding, suffix_tree, token_codes, url_filters
from shoal.llm.common import read, scratch_path

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("op1_line_dedup")
def op1(spark, sf_dir):
    return line_dedup.line_dedup(read(spark, sf_dir, "documents"))


@query("op2_html_extraction")
def op2(spark, sf_dir):
    return html_extract.extract(read(spark, sf_dir, "pages"))


@query("op3_ngram_jaccard_join")
def op3(spark, sf_dir):
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"), width=4, num=85, den=100)


@query("op4_token_codes")
def op4(spark, sf_dir):
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    token_codes.write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_codes.listed(spark, path)


@query("op5_lm_scoring")
def op5(spark, sf_dir):
    return suffix_tree.fold_scores(read(spark, sf_dir, "documents"))


@query(
    "op6_sharding",
    """
    with recursive crc as (
        select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as crc
    ),
    t as (
        select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size,
               xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) as text_crc32
        from documents, crc
    ),
    o as (select *, coalesce(cast(doc_id as varchar), 'null:' || size || ':' || text_crc32 || ':' || (row_number() over (partition by doc_id, text_crc32 order by size) - 1)) as owner from t),
    d as (select doc_id, size, text_crc32, ('0x' || substr(md5(owner), 1, 8))::bigint % 4096 as virtual_slot from o),
    s as (
        select virtual_slot, coalesce(sum(size), 0)::bigint as bytes, count(size) as n, row_number() over (order by coalesce(sum(size), 0) desc, virtual_slot) as place
        from (select range as virtual_slot from range(4096)) left join d using (virtual_slot) group by virtual_slot
    ),
    deal as (
        select 0::bigint as place, list_transform(range(16), lambda i: 0::bigint) as load, 0::bigint as virtual_slot, 0::bigint as shard
        union all
        select place, list_transform(load, lambda x, i: case when i = least then x + bytes else x end), virtual_slot, least - 1
        from (select s.place, load, s.virtual_slot, bytes, list_position(load, list_min(load)) as least from deal join s on s.place = deal.place + 1)
    ),
    m as (
        select virtual_slot, shard, bytes, n, coalesce(sum(n) over (partition by shard order by virtual_slot rows between unbounded preceding and 1 preceding), 0) as bef,
               case when sum(bytes) over (partition by shard order by bytes desc, virtual_slot rows between unbounded preceding and current row)
                         <= sum(bytes) over (partition by shard) - sum(bytes) over () / 17.0::double then 16 else shard end as next_shard
        from deal join s using (virtual_slot, place) where place > 0
    )
    select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'bytes' as law, shard::int as shard,
           (bef + row_number() over (partition by virtual_slot order by doc_id nulls first, size, text_crc32) - 1)::bigint as slot,
           null::int as grown_shard, virtual_slot::int as virtual_slot, 1 as map_version, next_shard::int as next_shard
    from d join m using (virtual_slot)
    """,
)
def op6(spark, sf_dir):
    return sharding.shard(read(spark, sf_dir, "documents"), scratch_path(spark, "slot-maps"), shards=16)


@query(
    "op7_mixing",
    r"""
    with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                      md5('mix:' || coalesce(cast(doc_id as varchar), '')) as key from documents),
    s as (select source, sum(size) as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
    w as (select *, case place % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight, 2.0::double * source_size as most from s),
    f as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(most) over (order by most / weight, place rows between unbounded preceding and 1 preceding), 0))
                    / sum(weight) over (order by most / weight, place rows between current row and unbounded following) as level from w),
    t as (select source, source_size, case when level >= most / weight then most
                 else weight * (select arg_min(level, (most / weight, place)) from f where level < most / weight) end as target from f),
    b as (select *, cast(floor(target + 0.5) as bigint) as budget from t),
    e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from b),
    o as (select doc_id, source, size, coalesce(sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bef from d)
    select o.doc_id, cast(o.size as bigint) as size, cast(e.source_size as bigint) as source_size, e.target,
           cast(epochs * o.size + greatest(0, least(o.size, budget - epochs * e.source_size - bef)) as bigint) as taken
    from o join e on o.source is not distinct from e.source
    """,
)
def op7(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


@query("op8_decontamination")
def op8(spark, sf_dir):
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query(
    "op9_exact_dedup",
    """
    select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
           doc_id is not distinct from max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256,
    from documents window g as (partition by coalesce(text, ''))
    """,
)
def op9(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents")).drop("n_chunks")


@query("op10_language_id")
def op10(spark, sf_dir):
    return language_id.identified(read(spark, sf_dir, "documents"))


#: (host, path, verdict) of the contract.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query(
    "op11_url_filters",
    f"""
    with r(host, path, verdict) as (values {", ".join(map(str, URL_RULES))}),
    u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) as raw from u),
    p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) as path from h),
    k as (select p.host, p.path, max((length(r.host || r.path), length(r.host), r.host || r.path, r.verdict)) as best
          from (select distinct host, path from p) p join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by p.host, p.path)
    select page_id, host, path, best[3] as rule, coalesce(best[4], 'allow') as verdict from p left join k using (host, path)
    """,
)
def op11(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.url_filters(read(spark, sf_dir, "pages"), rules)


@query(
    "op12_phrases",
    r"""
    with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
    p as (select lang, regexp_extract_all(unnest(regexp_extract_all(text, '[^.,;:!?
-
]+')), '[^ 	]+') as w from d),
    g as (select lang, w, unnest(range(1, len(w) + 1)) as i from p),
    f as (select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase, count(*) as f from g, (select unnest([1, 2, 3, 4]) as m) where i + m - 1 <= len(w) group by all),
    n as (select lang, sum(f)::bigint as n from f where m = 1 group by lang),
    c as (select lang, phrase, m, f as a, string_split(phrase, ' ') as w from f where m > 1 and f >= 30),
    k as (select lang, phrase, m, a, array_to_string(w[1:k], ' ') as one, array_to_string(w[k + 1:m], ' ') as two, k from c, (select unnest([1, 2, 3]) as k) where k < m),
    s as (select k.*, l.f as l, r.f as r, 2000000::hugeint * a // (l.f + r.f) as score from k join f l on l.lang = k.lang and l.phrase = one join f r on r.lang = k.lang and r.phrase = two),
    b as (select lang, phrase, a, min((score, k, l, r)) as best from s group by all),
    i as (select lang, array_to_string(w[j : j + size - 1], ' ') as phrase, max(a) as longer from c, (select unnest([1, 2, 3]) as j), (select unnest([2, 3]) as size) where size < m and j + size - 1 <= m group by all),
    t as (select lang, phrase, a, best, row_number() over (partition by lang order by best[1] desc, a desc, phrase) as rank from b left join i using (lang, phrase) where longer is null or 100::hugeint * longer < 80::hugeint * a)
    select lang, rank::bigint as rank, phrase, a::bigint as a, best[3]::bigint as l, best[4]::bigint as r, n, best[1]::bigint as score from t join n using (lang) where rank <= 2000
    """,
)
def op12(spark, sf_dir):
    return phrases.phrases(read(spark, sf_dir, "documents"))


def _cluster_rounds(rounds: int = 3) -> str:
    parts = []
    for i in range(rounds + 1):
        parts.append(f"d{i} as (select v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x)) as distance from v join c{i} c using (i) group by all)")
        parts.append(f"a{i} as (select row, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance from d{i} group by row)")
        if i < rounds:
            parts.append(f"m{i} as (select cluster, i, sum(x) as s, count(*) as n from v join a{i} using (row) group by all)")
            parts.append(f"c{i + 1} as (select cluster, i, coalesce((s - ((s % n) + n) % n) // n, x) as x from c{i} left join m{i} using (cluster, i))")
    return ", ".join(parts)


@query(
    "op13_pivot_clusters",
    f"""
    with k as (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
               where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
    v as (select row, unnest(range(64)) as i, unnest(v)::hugeint as x from k),
    f as (select row, row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), v) - 1 as cluster from k qualify cluster < 16),
    c0 as (select cluster, i, x from f join v using (row)),
    {_cluster_rounds()},
    h as (select cluster, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from c3 group by cluster)
    select vec_id, cluster::int as cluster, distance::bigint as distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, centroid_sha256
    from k join a3 using (row) join h using (cluster)
    """,
)
def op13(spark, sf_dir):
    return pivot_clusters.clusters(read(spark, sf_dir, "embeddings"))

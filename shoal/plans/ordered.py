"""Registered queries of hot keys, as-of settings, nested layouts and searches for many needles, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoal.functions import config
from shoal.operators import chains, lookup, ranges, search, tree
from shoal.plans.catalogue import CHAIN, chain, query
from shoal.session import table

# Hot keys: the five kinds of events are five keys of a fifth of the rows each

HOT = """
    e as (select event_type, cast(floor(epoch(ts)) as bigint) as sec, event_id, cast(floor(value) as bigint) as n from events),
    p as (select event_type, sec, event_id, n, row_number() over w as i, sum(n) over w as upto, min(n) over () as least from e window w as (partition by event_type order by sec, event_id)),
"""


def hot_stream(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"), "event_id", F.floor("value").cast("bigint").alias("n"))


@query(
    f"""
    with recursive {HOT}
    s as (
        select event_type, i, 0::bigint as batch_id, sec, upto - n as bef from p where i = 1
        union all
        select s.event_type, x.i, s.batch_id + 1, x.sec, x.upto - x.n
        from s, lateral (select min(case when p.sec >= s.sec + 20000 then p.i when p.upto - p.n - s.bef >= 3000 then p.i end) as nxt from p where p.event_type = s.event_type and p.i > s.i) c
        join p x on x.event_type = s.event_type and x.i = c.nxt
    ),
    b as (select *, lead(i) over (partition by event_type order by i) as nxt from s),
    g as (select b.event_type, batch_id, any_value(b.sec) as opened_at, count(*) as n_chunks, sum(n) as size, any_value(nxt) as nxt from b join p on p.event_type = b.event_type and p.i >= b.i and (b.nxt is null or p.i < b.nxt) group by 1, 2)
    select event_type, batch_id, opened_at, n_chunks::int as n_chunks, size::bigint as size, case when size >= 3000 then 'size' when nxt is null then 'exit' else 'timer' end as reason from g
    """
)
def micro_batch_hot(spark, sf_dir):
    return chains.micro_batches(hot_stream(spark, sf_dir), "event_type", ["sec", "event_id"], "sec", "n", gap=20000, most=3000)


@query(
    f"""
    with recursive {HOT}
    s(event_type, i, sec, event_id, n, reset_at, room, accepted) as (
        select event_type, i, sec, event_id, n, sec + 20000, case when n <= 2000 then 2000 - n else 2000 end, n <= 2000 from p where i = 1
        union all
        select p.event_type, p.i, p.sec, p.event_id, p.n, case when p.sec >= s.reset_at then p.sec + 20000 else s.reset_at end,
               r.room - case when p.n <= r.room then p.n else 0 end, p.n <= r.room
        from s join p on p.event_type = s.event_type and p.i = s.i + 1, lateral (select case when p.sec >= s.reset_at then 2000 else s.room end as room) r)
    select event_type, sec, event_id, n, accepted from s
    """
)
def rate_limit_hot(spark, sf_dir):
    return chains.rate_limited(hot_stream(spark, sf_dir), "event_type", ["sec", "event_id"], "sec", "n", budget=2000, window=20000)


@query(
    """
    with c as (select role, string_agg(text, '' order by conv_id, turn) as t from conversations group by 1), w as (select unnest(['the', '.A', '?T', 'zqzq']) as wanted)
    select role, wanted from c, w where contains(t, wanted)
    """
)
def output_contains_hot(spark, sf_dir):
    """Two or three keys hold all rows; some of the texts stand only where one chunk ends and the next begins."""
    c = table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", "text")
    found = [chains.holding(c, "role", ["conv_id", "turn"], "text", w).withColumn("wanted", F.lit(w)) for w in ("the", ".A", "?T", "zqzq")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("select role, conv_id, turn, coalesce(sum(length(text)) over (partition by role order by conv_id, turn rows between unbounded preceding and 1 preceding), 0)::bigint as start, length(text)::bigint as n from conversations")
def output_offsets(spark, sf_dir):
    return chains.offsets(table(spark, sf_dir, "conversations"), "role", ["conv_id", "turn"], "text")


# Settings in force at each row's time

OPTIONS = ('"fontSize":{n}', '"fontSize":"big"', '"fontSize":{n}.6,"bell":true', '"bell":1')


@query(
    """
    with e as (select event_id, user_id % 3 as window_id, ts, event_type, floor(value)::bigint as n from events),
    s as (select window_id, ts, arg_max(case event_id % 4 when 0 then greatest(6, least(72, n)) when 2 then greatest(6, least(72, floor(n + 0.6 + 0.5))) else 14 end, event_id)::int as font, arg_max(event_id % 4 = 2, event_id) as bell
          from e where event_type = 'signup' group by 1, 2)
    select event_id, e.window_id, coalesce(font, 14)::int as font_size, coalesce(bell, false) as bell from e asof left join s on e.window_id = s.window_id and e.ts >= s.ts where event_type <> 'signup'
    """
)
def settings_as_of(spark, sf_dir):
    """Each row under its window's settings as they were at its time, the defaults before the first change."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("window_id"), "ts", "event_type", F.floor("value").cast("string").alias("n"))
    form = F.element_at(F.array(*map(F.lit, OPTIONS)), (F.col("event_id") % 4 + 1).cast("int"))
    raw = F.concat(F.lit("{"), F.replace(form, F.lit("{n}"), F.col("n")), F.lit("}"))
    changes = e.where("event_type = 'signup'").select("window_id", "ts", "event_id", config.coerced(raw).alias("settings"))
    got = ranges.as_of(e.where("event_type <> 'signup'"), changes, "window_id", "ts", "settings", ["event_id"])
    return got.select("event_id", "window_id", F.coalesce("settings.fontSize", F.lit(14)).alias("font_size"), F.coalesce("settings.bell", F.lit(False)).alias("bell"))


@query(
    """
    select c_custkey, count(o_orderkey) as n_sessions, coalesce(c_nationkey % 3 = 0, false) and count(o_orderkey) > 1 as confirm
    from customer left join orders on c_custkey = o_custkey and o_orderpriority = '1-URGENT' group by c_custkey, c_nationkey
    """
)
def close_confirm_flag(spark, sf_dir):
    """Whether closing asks first: the window's own flag and more than one session."""
    owners = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 3 == 0).alias("confirm_on_close"))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return lookup.close_confirmations(owners, urgent, "c_custkey", "o_custkey").drop("confirm_on_close")


# Nested layouts

LAYOUT = """
    l as (select tab, string_agg(case when turn < last then '{"type":"split","direction":"' || case when turn % 2 = 0 then 'row' else 'column' end || '","children":[{"type":"leaf","id":"p' || turn || '"},' else '{"type":"leaf","id":"p' || turn || '"}' end, '' order by turn)
                      || repeat('],"sizes":[0.5,0.5]}', max(last)) as layout from c group by tab)
"""


@query(f"with {CHAIN}, {LAYOUT} select tab, layout from l")
def tree_to_nested(spark, sf_dir):
    return tree.nested(chain(spark, sf_dir))


@query(
    f"""
    with recursive {CHAIN}, {LAYOUT},
    n as (select tab, 'r' as path, layout::json as v from l
          union all
          select tab, path || i, json_extract(v, '$.children[' || i || ']') from n, (select unnest([0, 1]) as i) where json_extract_string(v, '$.type') = 'split')
    select tab, path, json_extract_string(v, '$.id') as id, json_extract_string(v, '$.direction') as direction, json_extract(v, '$.sizes[0]')::double as size0, json_extract(v, '$.sizes[1]')::double as size1 from n
    """
)
def tree_from_nested(spark, sf_dir):
    """Nested layouts, one text a tab, as the path table that all tree operators take."""
    return tree.from_nested(tree.nested(chain(spark, sf_dir)), "tab", "layout")


# Searches

_PICK = "substr(string_split(p_name, ' ')[1], 1, 2) || substr(string_split(p_name, ' ')[2], 1 + p_size::int % 3, 1)"


@query(
    f"""
    with n as (select distinct {_PICK} as needle from part), l as (select p_partkey, p_name, lower(p_name) as low from part),
    s as (select needle, p_partkey, p_name, length(regexp_extract(low, '(?s)^.*?' || array_to_string(string_split(needle, ''), '.*?'), 0)) - length(needle) as score
          from l, n where regexp_matches(low, '(?s)^.*?' || array_to_string(string_split(needle, ''), '.*?'))),
    r as (select *, row_number() over (partition by needle order by score, p_name, p_partkey) as place from s)
    select needle, place::int as place, p_partkey as ordinal, p_name as label, score::int as score from r where place <= 60
    """
)
def fuzzy_many(spark, sf_dir):
    """The best 60 labels of every needle at once; needles are two letters of a name's first word and one of its second."""
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    needle = F.concat(F.substring(words[0], 1, 2), F.substr(words[1], F.col("p_size").cast("int") % 3 + 1, F.lit(1)))
    return search.many_searches(part, part.select(needle.alias("needle")), "p_name", "p_partkey", "needle")

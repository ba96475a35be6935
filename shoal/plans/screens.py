"""More registered queries of the core library: settings, channels, palettes, trees and pixels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoal.functions import config, text, validate
from shoal.operators import chains, lookup, position, raster, resolve, tree
from shoal.plans.catalogue import CHAIN, chain, query, requests, stream
from shoal.session import table

# Settings: every field from texts of many kinds

FORMS = {
    "fontFamily": ['"fontFamily":"Mono"', '"fontFamily":7', '"evil":"x"', '"fontFamily":"' + "m" * 513 + '"'],
    "fontSize": ['"fontSize":9999', '"fontSize":-5', '"fontSize":14.7', '"fontSize":"huge"', '"fontSize":null', '"fontSize":20', '"fontSize":[1]'],
    "lineHeight": ['"lineHeight":0.1', '"lineHeight":1.5', '"lineHeight":true'],
    "letterSpacing": ['"letterSpacing":-50', '"letterSpacing":2.5', '"letterSpacing":{}'],
    "scrollback": ['"scrollback":10', '"scrollback":1000.4', '"scrollback":1000000000', '"scrollback":"1"'],
    "cursorStyle": ['"cursorStyle":"block"', '"cursorStyle":"laser"', '"cursorStyle":1'],
    "renderer": ['"renderer":"canvas"', '"renderer":"raytraced"'],
    "theme": ['"theme":"Nord"', '"theme":false', '"evil":2'],
    "cursorBlink": ['"cursorBlink":false', '"cursorBlink":"yes"'],
    "vibrancy": ['"vibrancy":false', '"vibrancy":0', '"evil":3'],
    "shell": ['"shell":"/bin/zsh"', '"shell":"a shell"', '"shell":42', '"shell":"/bin/sh\\t"', '"shell":""'],
    "shellArgs": ['"shellArgs":["-l","-i"]', '"shellArgs":"-l"', '"shellArgs":[1,2]', '"shellArgs":[]', '"shellArgs":[' + ",".join(f'"a{i}"' for i in range(40)) + "]"],
    "lastSession": ['"lastSession":["/tmp",42,"",null]', '"lastSession":[' + ",".join(f'"/d{i}"' for i in range(50)) + "]", '"lastSession":"x"'],
}
WHOLES = ["null", "42", '"text"', "[]", "true", "{", "{}"]


def _sql_settings() -> str:
    """Each field by json_type and json_extract, as the settings' rules say it."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    pick = lambda forms, i: f"list_extract([{', '.join(map(lit, forms))}], cast((event_id // {i}) % {len(forms)} as int) + 1)"
    parts = " || ',' || ".join(pick(f, i + 1) for i, f in enumerate(FORMS.values()))
    kind, value = lambda k: f"json_type(j, '$.{k}')", lambda k: f"json_extract_string(j, '$.{k}')"
    cols = [f"case when {kind(k)} = 'VARCHAR' and length({value(k)}) <= 512 then {value(k)} else {lit(d)} end as {k}" for k, d in config.STRINGS.items()]
    for k, (d, low, high, whole) in config.NUMBERS.items():
        v = f"case when {kind(k)} in ('BIGINT', 'UBIGINT', 'DOUBLE') then least({high}, greatest({low}, cast({value(k)} as double))) else {d} end"
        cols.append(f"cast(floor({v} + 0.5) as int) as {k}" if whole else f"cast({v} as double) as {k}")
    cols += [f"case when {kind(k)} = 'VARCHAR' and {value(k)} in ({', '.join(map(lit, of))}) then {value(k)} else {lit(d)} end as {k}" for k, (d, of) in config.ENUMS.items()]
    cols += [f"case when {kind(k)} = 'BOOLEAN' then {value(k)} = 'true' else {str(d).lower()} end as {k}" for k, d in config.BOOLEANS.items()]
    cols.append(f"case when {kind('shell')} = 'VARCHAR' and {value('shell')} <> '' and not contains({value('shell')}, ' ') then trim({value('shell')}, chr(9)) end as shell")
    each = lambda k: f"(select list(x.value order by x.key) from json_each(j, '$.{k}') x)"
    texts = lambda k, most, keep: f"(select string_agg(v, '|' order by i) from (select json_extract_string(x.value, '$') as v, cast(x.key as int) as i from json_each(j, '$.{k}') x where {keep} order by i limit {most}))"
    array = lambda k: f"{kind(k)} = 'ARRAY'"
    odd = "(select count(*) from json_each(j, '$.shellArgs') x where x.type <> 'VARCHAR')"
    cols.append(f"case when {array('shellArgs')} and {odd} = 0 then coalesce({texts('shellArgs', 32, 'true')}, '') end as shellArgs")
    good = "x.type = 'VARCHAR' and length(json_extract_string(x.value, '$')) between 1 and 4096"
    cols.append(f"case when {array('lastSession')} then coalesce({texts('lastSession', 20, good)}, '') else '' end as lastSession")
    return f"with r as (select event_id, case when event_id % 11 = 0 then {pick(WHOLES, 11)} else '{{' || {parts} || '}}' end as raw from events), p as (select event_id, case when json_valid(raw) then cast(raw as json) end as j from r) select event_id, {', '.join(cols)} from p"


@query(_sql_settings())
def settings_all_fields(spark, sf_dir):
    pick = lambda forms, i: F.element_at(F.array(*map(F.lit, forms)), (F.floor(F.col("event_id") / i) % len(forms)).cast("int") + 1)
    body = F.concat(F.lit("{"), F.concat_ws(",", *[pick(f, i + 1) for i, f in enumerate(FORMS.values())]), F.lit("}"))
    raw = F.when(F.col("event_id") % 11 == 0, pick(WHOLES, 11)).otherwise(body)
    s = table(spark, sf_dir, "events").select("event_id", config.coerced(raw).alias("s")).select("event_id", "s.*")
    return s.withColumn("shellArgs", F.array_join("shellArgs", "|")).withColumn("lastSession", F.array_join("lastSession", "|"))


# Checks


@query(
    """
    select event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) as session_id
    from (select event_id, md5(cast(event_id as varchar)) as h from events)
    """
)
def uuid_assert(spark, sf_dir):
    h = F.md5(F.col("event_id").cast("string"))
    part = lambda a, n: F.substring(h, a, n)
    u = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))
    return table(spark, sf_dir, "events").select("event_id", validate.asserted_uuid(u).alias("session_id"))


CHANNELS = ["pty:create", "pty:exit", "app:info", "menu:action", "window:explode", ""]


@query(
    f"""
    with c as (select event_id, event_type, list_extract({CHANNELS}, cast(event_id % {len(CHANNELS)} as int) + 1) as channel from events)
    select event_id, channel in ('pty:create', 'app:info') as invoke, channel in ('pty:exit', 'menu:action') as event, channel <> '' as named, event_type = 'click' as same,
           channel in ('pty:create', 'app:info') as ok, case when channel in ('pty:create', 'app:info') then event_type end as value, case when channel not in ('pty:create', 'app:info') then 'request failed' end as error from c
    """
)
def channel_allowlists(spark, sf_dir):
    c = table(spark, sf_dir, "events").withColumn("channel", F.element_at(F.array(*map(F.lit, CHANNELS)), (F.col("event_id") % len(CHANNELS)).cast("int") + 1))
    invoke = validate.one_of(F.col("channel"), validate.INVOKE_CHANNELS)
    out = c.select(
        "event_id", invoke.alias("invoke"), validate.one_of(F.col("channel"), validate.EVENT_CHANNELS).alias("event"), validate.truthy(F.col("channel")).alias("named"),
        validate.same_page(F.col("event_type"), F.lit("click")).alias("same"), validate.envelope(invoke, F.col("event_type"), F.lit("request failed")).alias("e"),
    )
    return out.select("event_id", "invoke", "event", "named", "same", "e.*")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def known_senders(spark, sf_dir):
    senders = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return lookup.known(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), senders, "o_custkey")


@query(
    """
    with a as (select doc_id, string_split(substr(text, 1, 400), ' ') as w from documents)
    select doc_id, len(list_filter(w, lambda x: length(x) = 0)) = 0 as every_one, array_to_string(list_filter(w, lambda x: length(x) > 3)[1:32], ' ') as long_ones, substr(array_to_string(w, ' '), 1, 40) as copied from a
    """
)
def array_rules(spark, sf_dir):
    w = F.split(F.substring("text", 1, 400), " ", -1)
    some = F.slice(F.filter(w, lambda x: F.length(x) > 3), 1, config.MAX_ARGS)
    return table(spark, sf_dir, "documents").select("doc_id", F.forall(w, lambda x: F.length(x) > 0).alias("every_one"), F.array_join(some, " ").alias("long_ones"), text.capped(F.col("text"), 40).alias("copied"))


# Lookups


@query(
    """
    with n as (select s_suppkey, case when s_suppkey % 3 = 0 then 'NOWHERE' else n_name end as wanted, r_name as other from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
    select s_suppkey, case when wanted = 'NOWHERE' then other else wanted end as resolved from n
    """
)
def name_or_fallback(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    s = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "NOWHERE").otherwise(F.col("n_name")).alias("wanted"), F.col("r_name").alias("other"))
    return lookup.resolved(s, n, "wanted", "n_name", "other").select("s_suppkey", "resolved")


@query("select l_orderkey, l_linenumber, o_custkey from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R'")
def exits_to_tabs(spark, sf_dir):
    """Each exit (line) to the tab (customer) whose panes (orders) hold it."""
    exits = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("session_id"), "l_linenumber")
    panes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), "o_custkey")
    return lookup.routed(exits, panes).select(F.col("session_id").alias("l_orderkey"), "l_linenumber", "o_custkey")


@query("select o_orderkey as session_id, o_custkey as window_id from orders where o_custkey % 7 <> 0")
def release_group(spark, sf_dir):
    sessions, _ = requests(spark, sf_dir)
    return lookup.released_all(sessions, sessions.where("window_id % 7 = 0"), "window_id")


@query("with x as (select user_id, min(ts) as at from events where event_type = 'purchase' group by 1) select event_id, e.user_id, x.at is null or e.ts < x.at as accepted from events e left join x using (user_id)")
def writes_after_exit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return lookup.before_exit(e, e.where("event_type = 'purchase'"), "user_id", "ts").select("event_id", "user_id", "accepted")


@query("with c as (select conv_id, string_agg(text, '' order by turn) as t from conversations group by 1) select conv_id from c where contains(t, 'the')")
def output_contains(spark, sf_dir):
    return chains.holding(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", "the")


@query("select page_id, url from pages where url <> '' order by page_id limit 20")
def saved_directories(spark, sf_dir):
    return lookup.last_directories(table(spark, sf_dir, "pages").select("page_id", "url"), ["page_id"], "url")


RESTORE = "with d as (select 'n' || n_nationkey as directory from nation), s as (select distinct 'n' || (s_suppkey % 40) as directory from supplier), r as (select * from s where directory in (select directory from d))"


@query(f"{RESTORE} select directory, cast(count(*) over () as bigint) as n_restored from r union all select '~', 0 where not exists (select 1 from r)")
def restore_session(spark, sf_dir):
    here = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("directory"))
    stored = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), (F.col("s_suppkey") % 40).cast("string")).alias("directory")).distinct()
    got = lookup.restored(stored, here, "directory", spark.createDataFrame([("~",)], "directory string"))
    n = lookup.known(stored, here, "directory").agg(F.count(F.lit(1)).alias("n_restored"))
    return got.crossJoin(F.broadcast(n))  # one row


@query("select '~' as directory")
def restore_nothing(spark, sf_dir):
    stored = table(spark, sf_dir, "supplier").select(F.concat(F.lit("gone"), F.col("s_suppkey").cast("string")).alias("directory"))
    here = table(spark, sf_dir, "nation").select(F.col("n_name").alias("directory"))
    return lookup.restored(stored, here, "directory", spark.createDataFrame([("~",)], "directory string"))


# Positions


@query(
    """
    with a as (select user_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1), e as (select e.*, lag(floor(e.value / 50)) over (partition by user_id order by ts, event_id) as p from events e join a using (user_id, event_type))
    select event_id, user_id from e where p is distinct from floor(value / 50)
    """
)
def active_titles(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("title", F.floor(F.col("value") / 50))
    active = position.latest(e, "user_id", ["ts", "event_id"], "event_type")
    return position.active_changes(e, active, "user_id", "event_type", ["ts", "event_id"], "title").select("event_id", "user_id")


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id from events where event_type = 'view' group by 1")
def latest_size(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return position.latest(e, "user_id", ["ts", "event_id"], "event_id")


# Texts and palettes


@query(
    """
    select p_partkey, case when p_size % 2 = 0 then 'Cmd+' else 'Ctrl+Shift+' end || upper(substr(p_name, 1, 1)) as accelerator, cast(least(72, greatest(6, p_size + p_partkey % 60 - 20)) as int) as zoomed,
           array_to_string(string_split(p_type, ' '), '; ') as policy from part
    """
)
def labels_and_zoom(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    platform = F.when(F.col("p_size") % 2 == 0, "darwin").otherwise("linux")
    return p.select(
        "p_partkey", text.accelerator(F.upper(F.substring("p_name", 1, 1)), platform).alias("accelerator"), text.zoomed(F.col("p_size"), F.col("p_partkey") % 60 - 20).cast("int").alias("zoomed"), text.policy(F.split("p_type", " ")).alias("policy")
    )


@query("select c_custkey, case when c_acctbal > 0 then '#1a1b26' else '#ffffff' end as color, case when c_acctbal > 0 then '#c0caf5' else '#24292f' end as symbol, 40 as height from customer")
def overlay_colors(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", resolve.overlay(F.col("c_acctbal") > 0).alias("o")).select("c_custkey", "o.*")


@query(
    """
    select cast(i as int) as ordinal, label, hint from (values (0, 'New Tab', 'Ctrl+Shift+T'), (1, 'Split Right', 'Ctrl+Shift+D'), (2, 'Zoom In', null)) f(i, label, hint)
    union all select cast(row_number() over (order by n_name) + 2 as int), 'Theme: ' || n_name, case when n_regionkey > 1 then 'dark' else 'light' end from nation
    """
)
def palette_entries(spark, sf_dir):
    fixed = [("New Tab", "Ctrl+Shift+T"), ("Split Right", "Ctrl+Shift+D"), ("Zoom In", None)]
    return resolve.palette(spark, fixed, table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_regionkey") > 1).alias("dark")))


# Trees


@query("select conv_id as tab, 'r' as path, 'p' || min(turn) as id, cast(null as varchar) as direction, cast(null as double) as size0, cast(null as double) as size1 from conversations group by 1")
def tree_leaf(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("p"), F.min("turn").cast("string")).alias("id"))
    return tree.leaf(c, "conv_id", "id")


@query(f"with {CHAIN} select tab, cast(count(id) as bigint) as n_leaves, count(id) > 1 as many from t group by tab")
def tree_leaf_counts(spark, sf_dir):
    return tree.leaf_counts(chain(spark, sf_dir))


@query(f"with {CHAIN} select tab, arg_min(id, path) as id from t where id is not null group by tab")
def tree_first_leaf(spark, sf_dir):
    return tree.first_leaf(chain(spark, sf_dir))


@query(f"with {CHAIN} select tab, id from t where id = 'p2'")
def tree_contains(spark, sf_dir):
    t = chain(spark, sf_dir)
    return tree.contains(t, t.select("tab").distinct().withColumn("id", F.lit("p2")))


@query(f"with {CHAIN}, n as (select tab, id, coalesce(lead(id) over w, lag(id) over w) as neighbour from t where id is not null window w as (partition by tab order by path)) select * from n where id = 'p1'")
def tree_neighbour(spark, sf_dir):
    t = chain(spark, sf_dir)
    return tree.neighbour_of(t, t.select("tab").distinct().withColumn("id", F.lit("p1")))


@query(f"with {CHAIN} select tab, string_agg(id, ',' order by path) as ids from t where id is not null group by tab")
def tree_leaf_list(spark, sf_dir):
    return lookup.ordered_text(tree.leaves(chain(spark, sf_dir)).withColumn("id", F.concat(F.lit(","), "id")), "tab", ["ordinal"], "id").select("tab", F.expr("substring(output, 2)").alias("ids"))


@query(
    f"""
    with {CHAIN}, e as (select tab, path from t where id = 'p0' and tab % 2 = 0)
    select t.* from t where not (id = 'p0' and tab % 2 = 0) or id is null
    union all select tab, path || '0', 'p0', null, null, null from e union all select tab, path || '1', 'new', null, null, null from e union all select tab, path, null, 'row', 0.5, 0.5 from e
    union all select tab + 1000000, 'r', 'new', null, null, null from (select distinct tab from t)
    """
)
def tree_split_odd(spark, sf_dir):
    """An unknown direction is a row, an absent target changes nothing, and tabs without a tree get a leaf."""
    t = chain(spark, sf_dir)
    tabs = t.select("tab").distinct()
    target = F.when(F.col("tab") % 2 == 0, "p0").otherwise("none")
    edits = tabs.select("tab", target.alias("target")).unionByName(tabs.select((F.col("tab") + 1000000).alias("tab"), F.lit("p0").alias("target")))
    return tree.split_leaves(t, edits.withColumn("new_id", F.lit("new")).withColumn("direction", F.lit("diagonal")))


# Pixels


@query(
    """
    with p as (select l_orderkey, l_linenumber, l_quantity as x, l_discount * 100 as y from lineitem), a as (select *, greatest(0, least(1, ((x - 5) * 30 + (y - 2) * 6) / 936.0)) as t from p),
    d as (select *, least(sqrt(power(x - (5 + t * 30), 2) + power(y - (2 + t * 6), 2)), sqrt(power(x - greatest(10, least(40, x)), 2) + power(y - 5, 2))) as near from a),
    c as (select *, greatest(0, least(1, 0.5 - (near - 3))) as cover from d)
    select l_orderkey, l_linenumber, round(near, 6) as near, round(cover, 6) as cover, case when cover <= 0 then 26 else floor(200 * cover + 26 * (1 - cover) + 0.5) end as shade from c
    """
)
def stroke_coverage(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    near = raster.nearest_segment(F.col("l_quantity"), F.col("l_discount") * 100, [(5, 2, 35, 8), (10, 5, 40, 5)])
    c = li.select("l_orderkey", "l_linenumber", near.alias("near")).withColumn("cover", raster.coverage(F.col("near") - 3))
    return c.select("l_orderkey", "l_linenumber", F.round("near", 6).alias("near"), F.round("cover", 6).alias("cover"), raster.blended(F.lit(26), F.lit(200), F.col("cover")).cast("double").alias("shade"))


@query(
    """
    with p as (select range % 64 as x, range // 64 as y from range(64 * 64)), s as (select s_suppkey, s_suppkey % 40 as r from supplier),
    d as (select s_suppkey, x, y, sqrt(power(x - greatest(8 + 4, least(x, 56 - 4)), 2) + power(y - greatest(r % 8 + 4, least(y, 60 - 4)), 2)) - 4 as box from p, s where y = r)
    select s_suppkey, cast(count_if(box <= 0) as bigint) as inside, round(sum(greatest(0, least(1, 0.5 - box))), 4) as covered from d group by 1
    """
)
def pixel_rows(spark, sf_dir):
    """One row of a 64 x 64 raster for each supplier: pixels meet suppliers by row number."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 40).cast("double").alias("y"))
    p = raster.pixels(spark, 64, 64).join(s, "y")
    cy = F.greatest(F.col("y") % 8 + 4, F.least(F.col("y"), F.lit(56.0)))
    cx = F.greatest(F.lit(12.0), F.least("x", F.lit(52.0)))
    box = p.withColumn("box", F.hypot(F.col("x") - cx, F.col("y") - cy) - 4)
    return box.groupBy("s_suppkey").agg(F.count_if(F.col("box") <= 0).alias("inside"), F.round(F.sum(raster.coverage(F.col("box"))), 4).alias("covered"))


# Streams in batch form


@query("select user_id, cast(floor(epoch(ts)) as bigint) as sec, event_id from events where event_id % 2 = 0")
def routed_output(spark, sf_dir):
    """Chunks to the windows that own their session; those of unknown sessions are dropped."""
    chunks = stream(spark, sf_dir)
    panes = chunks.select("event_id").where("event_id % 2 = 0")
    return lookup.routed(chunks, panes, "event_id").select("user_id", "sec", "event_id")

"""Registered queries of the core library and the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoal.functions import config, text, validate
from shoal.functions.search import subsequence_score_col
from shoal.operators import folds, lookup, position, raster, resolve, tree
from shoal.operators.search import ranked_search
from shoal.session import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(
    """
    with s as (select p_partkey, p_name, length(regexp_extract(p_name, '(?s)^.*?c.*?w', 0)) - 2 as score
               from part where regexp_matches(p_name, '(?s)^.*?c.*?w'))
    select p_partkey, p_name, cast(score as int) as score from s order by score, p_name, p_partkey limit 60
    """
)
def fuzzy_topk(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return ranked_search(part, "p_name", "p_partkey", "cw").select("p_partkey", "p_name", F.col("score").cast("int").alias("score"))


@query("select p_partkey, p_name, 0 as score from part order by p_partkey limit 60")
def fuzzy_empty_query(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey", "")


NEEDLES = ("cw", "re", "bl", "ow", "zq")


@query(
    f"""
    with n as (select unnest({list(NEEDLES)}) as needle), s as (select p_partkey, needle, p_name, '(?s)^.*?' || array_to_string(string_split(needle, ''), '.*?') as pat from part, n)
    select p_partkey, needle, cast(length(regexp_extract(p_name, pat, 0)) - length(needle) as int) as score from s where regexp_matches(p_name, pat)
    """
)
def fuzzy_score_all(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.explode(F.array(*map(F.lit, NEEDLES))).alias("needle"))
    scored = part.select("p_partkey", "needle", subsequence_score_col(F.col("p_name"), F.col("needle")).cast("int").alias("score"))
    return scored.where("score is not null")


# Validation and text


@query(r"select doc_id, substr(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g'), 1, 512) as title, substr(text, 1, 120) as shown from documents")
def title_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_title(F.col("text")).alias("title"), text.shown_title(F.col("text")).alias("shown"))


URL_FORMS = ("%s", "javascript:%s", "FILE://%s", " %s", "mailto:a@b.example", "https://", "ftp://%s", "HTTPS://x.example/%s")


@query(
    r"""
    with u as (select page_id, i, replace(f, '%s', url) as url from pages, (select unnest(['%s', 'javascript:%s', 'FILE://%s', ' %s', 'mailto:a@b.example', 'https://', 'ftp://%s', 'HTTPS://x.example/%s']) as f,
               unnest(range(8)) as i)),
    l as (select *, lower(regexp_replace(url, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) as low from u)
    select page_id, cast(i as int) as form, length(url) between 1 and 2048 and (regexp_matches(low, '^mailto:') or regexp_matches(low, '^https?:[/\\]*[^/\\?#\s]+')
           and not regexp_matches(low, '^https?:[/\\]*[^/\\?#]*[\s<>^|%]')) as safe, starts_with(url, 'file://') or starts_with(url, 'data:') or starts_with(url, 'devtools://') as local from l
    """
)
def url_allowlist(spark, sf_dir):
    forms = F.posexplode(F.array(*[F.replace(F.lit(f), F.lit("%s"), F.col("url")) for f in URL_FORMS])).alias("form", "u")
    pages = table(spark, sf_dir, "pages").select("page_id", forms)
    return pages.select("page_id", "form", validate.safe_url(F.col("u")).alias("safe"), validate.local_url(F.col("u")).alias("local"))


@query("select doc_id, coalesce(strlen(text) <= 2048, false) as fits, length(text) between 1 and 4096 and not contains(text, chr(0)) as directory from documents")
def byte_cap(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", validate.within_bytes(F.col("text"), 2048).alias("fits"), validate.valid_directory(F.col("text")).alias("directory"))


@query(
    """
    with h as (select event_id, md5(cast(event_id as varchar)) as h from events),
    u as (select event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || case when event_id % 3 = 0 then '1' else '4' end || substr(h, 14, 3) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)
          || case when event_id % 7 = 0 then chr(10) else '' end as u from h)
    select event_id, regexp_matches(u, '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') as ok from u
    """
)
def uuid_check(spark, sf_dir):
    h = F.md5(F.col("event_id").cast("string"))
    part = lambda a, n: F.substring(h, a, n)
    version = F.when(F.col("event_id") % 3 == 0, "1").otherwise("4")
    u = F.concat(F.concat_ws("-", part(1, 8), part(9, 4), F.concat(version, part(14, 3)), part(17, 4), part(21, 12)), F.when(F.col("event_id") % 7 == 0, "\n").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", validate.is_uuid_v4(u).alias("ok"))


@query("select p_partkey, p_size * 50.0 between 1 and 2000 and p_retailprice = floor(p_retailprice) and p_retailprice between 1 and 2000 as ok from part")
def dimension_check(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", validate.valid_dimensions(F.col("p_size") * 50, F.col("p_retailprice")).alias("ok"))


@query(
    r"""
    select page_id, regexp_extract(url, '[^/\\]*$', 0) as base, 'file:///' || replace(url, '\', '/') as file_url, url as decoded, cast(null as varchar) as malformed,
           regexp_extract(url, '^https?://[^/]*(.*)$', 1) as directory from pages
    """
)
def path_functions(spark, sf_dir):
    u = F.col("url")
    pages = table(spark, sf_dir, "pages")
    escape = F.concat(F.lit("out \x1b]7;"), F.regexp_replace(u, "^https?", "file"), F.lit("\x07 more"))
    encoded = F.replace(F.replace(u, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    return pages.select(
        "page_id",
        text.basename(u).alias("base"),
        text.file_url(u).alias("file_url"),
        text.percent_decoded(encoded).alias("decoded"),
        text.percent_decoded(F.concat(u, F.lit("%zz"))).alias("malformed"),
        text.announced_directory(escape).alias("directory"),
    )


@query("select l_orderkey, l_linenumber, floor((l_discount - l_tax) * 100 * 10000 + 0.5) / 10000 as rounded, least(0.9, greatest(0.1, l_quantity / 50)) as ratio from lineitem")
def rounding(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    value = (F.col("l_discount") - F.col("l_tax")) * 100
    return li.select("l_orderkey", "l_linenumber", text.rounded_half_up(value, 4).alias("rounded"), text.split_ratio(F.col("l_quantity"), F.lit(0), F.lit(50)).alias("ratio"))


# Settings


@query(
    """
    select event_id, cast(least(72, greatest(6, json_extract(props, '$.k')::double)) as int) as font_size, 10000 as scrollback, case event_type when 'click' then 'bar' else 'block' end as cursor,
           case when event_id % 2 = 0 then event_type end as shell from events
    """
)
def settings_coerce(spark, sf_dir):
    raw = F.concat(
        F.lit('{"fontSize":'),
        F.get_json_object("props", "$.k"),
        F.lit(',"scrollback":"many","evil":1,"cursorStyle":"'),
        F.when(F.col("event_type") == "click", "laser").otherwise("block"),
        F.lit('","shell":"'),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.col("event_type"), F.lit("\\t"))).otherwise("a shell"),
        F.lit('"}'),
    )
    s = table(spark, sf_dir, "events").select("event_id", config.coerced(raw).alias("s"))
    return s.select("event_id", F.col("s.fontSize").alias("font_size"), F.col("s.scrollback").alias("scrollback"), F.col("s.cursorStyle").alias("cursor"), F.col("s.shell").alias("shell"))


@query("select user_id, arg_max(json_extract(props, '$.k')::bigint, (ts, event_id)) as k from events group by user_id")
def settings_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return position.latest(e, "user_id", ["ts", "event_id"], "k")


@query(
    """
    select c_custkey, case when c_mktsegment = 'BUILDING' or c_custkey % 5 = 0 then 'xterm-256color' else c_mktsegment end as term, 4 as n_keys, cast(c_nationkey as varchar) as home from customer
    """
)
def environment_clean(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    term = F.when(F.col("c_mktsegment") == "BUILDING", "dumb").when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_mktsegment"))
    env = F.create_map(F.lit("TERM"), term, F.lit("NODE_OPTIONS"), F.lit("x"), F.lit("HOME"), F.col("c_nationkey").cast("string"), F.lit("GDK_BACKEND"), F.lit("y"))
    out = c.select("c_custkey", resolve.clean_environment(env).alias("e"))
    return out.select("c_custkey", F.col("e")["TERM"].alias("term"), F.size("e").alias("n_keys"), F.col("e")["HOME"].alias("home"))


# Lookups, owners and counts


def requests(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sessions = o.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("window_id"))
    return sessions, o.select(F.col("o_orderkey").alias("session_id"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("window_id"))


@query("select o_orderkey as session_id, o_custkey as window_id from orders where o_orderkey % 5 <> 0")
def owned_lookup(spark, sf_dir):
    sessions, asked = requests(spark, sf_dir)
    return lookup.owned(asked, sessions)


@query("select o_orderkey as session_id, o_custkey + 1 as window_id from orders where o_orderkey % 5 = 0")
def unowned_rejects(spark, sf_dir):
    sessions, asked = requests(spark, sf_dir)
    return lookup.unowned(asked, sessions)


@query("select c_custkey, count(o_orderkey) as n_sessions from customer left join orders on c_custkey = o_custkey and o_orderpriority = '1-URGENT' group by c_custkey")
def sessions_per_owner(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return lookup.live_counts(table(spark, sf_dir, "customer").select("c_custkey"), urgent, "c_custkey", "o_custkey")


@query("select o_custkey, array_to_string(list_sort(list(distinct o_orderkey)), ',') as session_ids from orders group by o_custkey")
def ids_by_owner(spark, sf_dir):
    ids = lookup.ids_by_owner(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return ids.withColumn("session_ids", F.array_join("session_ids", ","))


@query("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 1")
def close_confirm(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("select event_id, user_id, place from (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as place from events) where place <= 50")
def admission_cap(spark, sf_dir):
    return lookup.first_admitted(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "place")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def orphan_chunks(spark, sf_dir):
    return lookup.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("select d.doc_id, quality, toxic from documents d join labels using (doc_id)")
def routed_chunks(spark, sf_dir):
    return lookup.routed(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("select c_custkey, r_regionkey from customer, region")
def fanout(spark, sf_dir):
    return lookup.fanned_out(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "region").select("r_regionkey"))


@query("select conv_id, string_agg(text, '' order by turn) as output from conversations group by conv_id")
def ordered_output(spark, sf_dir):
    return lookup.ordered_text(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text")


@query(
    r"""
    with k as (select distinct split_part(p_name, ' ', 1) as word from part union select distinct substr(p_brand, 7, 2) || chr(cast(97 + p_size % 26 as int)) from part)
    select word from k where not exists (select 1 from documents where contains(text, word))
    """
)
def unread_keys(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    keys = part.select(F.split("p_name", " ")[0].alias("word")).union(part.select(F.concat(F.substring("p_brand", 7, 2), F.char(F.col("p_size") % 26 + 97)))).distinct()
    return lookup.unread_keys(keys, table(spark, sf_dir, "documents"), "word", "text")


@query(
    """
    with c as (select c_custkey, unnest([1, 2]) as priority, unnest([c_nationkey, (c_nationkey + 1) % 25]) as k from customer),
    e as (select c_custkey, arg_min(n_name, priority) as found from c join nation on n_nationkey = k where n_regionkey in (1, 2) group by 1)
    select c_custkey, coalesce(found, 'none') as resolved, found is not null as validated from customer left join e using (c_custkey)
    """
)
def priority_resolve(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.array("c_nationkey", F.pmod(F.col("c_nationkey") + 1, F.lit(25)))).alias("priority", "n_nationkey"))
    c = c.join(n.select("n_nationkey", F.col("n_name").alias("path")), "n_nationkey")
    return lookup.first_existing(c, n.where("n_regionkey in (1, 2)").select(F.col("n_name").alias("path")), "c_custkey", "priority", "path", "none")


THEMES = ["Tokyo Night", "GitHub Light", "BUILDING", "MACHINERY"]


@query(
    """
    with w as (select *, c_acctbal > 0 as dark, case when c_custkey % 3 = 0 then 'auto' else c_mktsegment end as setting from customer),
    x as (select *, case when setting = 'auto' then case when dark then 'Tokyo Night' else 'MACHINERY' end else setting end as wanted from w)
    select c_custkey, case when wanted in ('Tokyo Night', 'GitHub Light', 'BUILDING', 'MACHINERY') then wanted when dark then 'Tokyo Night' else 'GitHub Light' end as theme from x
    """
)
def theme_resolve(spark, sf_dir):
    setting = F.when(F.col("c_custkey") % 3 == 0, "auto").otherwise(F.col("c_mktsegment"))
    chosen = resolve.theme(setting, F.lit("MACHINERY"), F.lit(""), F.col("c_acctbal") > 0, THEMES)
    return table(spark, sf_dir, "customer").select("c_custkey", chosen.alias("theme"))


@query(
    """
    select s_suppkey, case when s_suppkey % 4 = 0 and s_nationkey % 2 = 0 then '/bin/zsh' when s_suppkey % 4 = 1 then '/opt/fish' when s_nationkey % 2 = 0 then '/bin/zsh' else '/bin/sh' end as file,
           case when s_suppkey % 4 = 1 or s_nationkey % 2 = 0 then '-l' else '' end as args from supplier
    """
)
def program_resolve(spark, sf_dir):
    explicit = F.when(F.col("s_suppkey") % 4 == 0, "/gone").when(F.col("s_suppkey") % 4 == 1, " /opt/fish ")
    env = F.create_map(F.lit("SHELL"), F.when(F.col("s_nationkey") % 2 == 0, "/bin/zsh").otherwise("/missing"))
    existing = F.array(F.lit("/opt/fish"), F.when(F.col("s_nationkey") % 2 == 0, "/bin/zsh").otherwise("/none"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", resolve.resolved_program(F.lit("linux"), env, explicit, existing).alias("r"))
    return s.select("s_suppkey", F.col("r.file").alias("file"), F.array_join("r.args", " ").alias("args"))


@query("select event_id, case when event_type = 'click' then props else 'request failed' end as message from events")
def redaction(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "ValidationError").otherwise("Error")
    return table(spark, sf_dir, "events").select("event_id", validate.redacted(kind, F.col("props")).alias("message"))


# Positions


@query("select conv_id, turn, coalesce(lead(turn) over w, lag(turn) over w) as neighbour from conversations window w as (partition by conv_id order by turn)")
def neighbour(spark, sf_dir):
    return position.neighbours(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], "turn")


@query(
    """
    with p as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from conversations)
    select a.conv_id, a.turn, b.turn as target from p a join p b on a.conv_id = b.conv_id and b.i = (a.i + 1) % a.n
    """
)
def cycle_next(spark, sf_dir):
    return position.cycled(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], "turn", 1)


@query(
    """
    with r as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from conversations where turn <> 1),
    c as (select conv_id from conversations where turn = 1)
    select conv_id, turn as selected from r join c using (conv_id) where i = least(1, n - 1)
    """
)
def after_close(spark, sf_dir):
    return position.selected_after_close(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], "turn", "turn = 1")


@query("select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) where p is distinct from event_type")
def change_detect(spark, sf_dir):
    return position.changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("select conv_id, turn, 't' || row_number() over (partition by conv_id order by turn) as id from conversations")
def numbered_ids(spark, sf_dir):
    return position.numbered_ids(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], "t")


# Layout trees: one a conversation, its last leaf split once a turn


def chain(spark, sf_dir):
    """The trees as they stand after splitting leaf k into k and k + 1, turn by turn, written by path."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tab"), F.col("turn").cast("int").alias("turn"))
    c = c.withColumn("last", F.max("turn").over(Window.partitionBy("tab")))
    at = lambda n: F.concat(F.lit("r"), F.repeat(F.lit("1"), n))
    none = F.lit(None)
    own = tree.row(F.when(F.col("turn") < F.col("last"), F.concat(at(F.col("turn")), F.lit("0"))).otherwise(at(F.col("turn"))), F.concat(F.lit("p"), F.col("turn").cast("string")), none, none, none)
    split = tree.row(at(F.col("turn")), none, F.when(F.col("turn") % 2 == 0, "row").otherwise("column"), F.lit(0.5), F.lit(0.5))
    return c.select("tab", F.inline(F.when(F.col("turn") < F.col("last"), F.array(own, split)).otherwise(F.array(own))))


CHAIN = """
    c as (select conv_id as tab, cast(turn as int) as turn, max(cast(turn as int)) over (partition by conv_id) as last from conversations),
    t as (select tab, 'r' || repeat('1', turn) || case when turn < last then '0' else '' end as path, 'p' || turn as id, cast(null as varchar) as direction, cast(null as double) as size0, cast(null as double) as size1 from c
          union all select tab, 'r' || repeat('1', turn), null, case when turn % 2 = 0 then 'row' else 'column' end, 0.5, 0.5 from c where turn < last)
"""


@query(f"with {CHAIN} select tab, id, row_number() over (partition by tab order by path) - 1 as ordinal from t where id is not null")
def tree_leaves(spark, sf_dir):
    return tree.leaves(chain(spark, sf_dir))


@query(
    f"""
    with {CHAIN}
    select tab, path, id, direction, size0, size1 from t where not (id is not null and id = 'p0')
    union all select tab, path || '0', 'p0', null, null, null from t where id = 'p0' union all select tab, path || '1', 'new', null, null, null from t where id = 'p0'
    union all select tab, path, null, 'column', 0.5, 0.5 from t where id = 'p0'
    """
)
def tree_split(spark, sf_dir):
    t = chain(spark, sf_dir)
    edits = t.select("tab").distinct().select("tab", F.lit("p0").alias("target"), F.lit("new").alias("new_id"), F.lit("column").alias("direction"))
    return tree.split_leaves(t, edits)


@query(
    f"""
    with {CHAIN}, k as (select distinct tab, last from c)
    select tab, case when starts_with(path, 'r11') then 'r1' || substr(path, 4) when last = 1 and path = 'r0' then 'r' else path end as path, id, direction, size0, size1
    from t join k using (tab) where last = 0 or not (last = 1 and path in ('r', 'r1')) and not (last > 1 and path in ('r1', 'r10'))
    """
)
def tree_remove(spark, sf_dir):
    t = chain(spark, sf_dir)
    return tree.remove_leaves(t, t.select("tab").distinct().withColumn("target", F.lit("p1")))


@query(f"with {CHAIN} select tab, path, id, direction, case when path = 'r1' and id is null then 0.9 else size0 end as size0, case when path = 'r1' and id is null then 0.1 else size1 end as size1 from t")
def tree_resize(spark, sf_dir):
    t = chain(spark, sf_dir)
    return tree.resize(t, t.select("tab").distinct().withColumn("path", F.lit("r1")).withColumn("ratio", F.lit(3.0)))


@query(
    """
    with c as (select conv_id as tab, cast(turn as int) as turn, max(cast(turn as int)) over (partition by conv_id) as last from conversations)
    select tab, 'p' || turn as id, 1 - power(0.5, (turn + 1) // 2) as x, 1 - power(0.5, turn // 2) as y,
           power(0.5, (least(turn + 1, last) + 1) // 2) as width, power(0.5, least(turn + 1, last) // 2) as height from c
    """
)
def tree_rectangles(spark, sf_dir):
    return tree.rectangles(chain(spark, sf_dir))


# Streams in batch form

FOLD = """
    with recursive e as (select user_id, cast(floor(epoch(ts)) as bigint) as sec, event_id, cast(floor(value) as bigint) as n, row_number() over (partition by user_id order by floor(epoch(ts)), event_id) as i from events),
"""


@query(
    FOLD
    + """
    s(user_id, i, batch_id, opened_at, size, n_chunks, closed) as (
        select user_id, i, 0, sec, n, 1, n >= 600 from e where i = 1
        union all
        select e.user_id, e.i, case when s.closed or e.sec >= s.opened_at + 86400 then s.batch_id + 1 else s.batch_id end, case when s.closed or e.sec >= s.opened_at + 86400 then e.sec else s.opened_at end,
               case when s.closed or e.sec >= s.opened_at + 86400 then e.n else s.size + e.n end, case when s.closed or e.sec >= s.opened_at + 86400 then 1 else s.n_chunks + 1 end,
               case when s.closed or e.sec >= s.opened_at + 86400 then e.n else s.size + e.n end >= 600
        from s join e on e.user_id = s.user_id and e.i = s.i + 1),
    b as (select user_id, batch_id, max(opened_at) as opened_at, max(n_chunks) as n_chunks, max(size) as size, max(size) >= 600 as full_up from s group by 1, 2)
    select user_id, cast(batch_id as bigint) as batch_id, opened_at, cast(n_chunks as int) as n_chunks, cast(size as bigint) as size,
           case when full_up then 'size' when batch_id = max(batch_id) over (partition by user_id) then 'exit' else 'timer' end as reason from b
    """
)
def micro_batch(spark, sf_dir):
    return folds.micro_batches(stream(spark, sf_dir), "user_id", ["sec", "event_id"], "sec", "n", gap=86400, most=600)


def stream(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"), "event_id", F.floor("value").cast("bigint").alias("n"))


@query(
    FOLD
    + """
    s(user_id, i, event_id, sec, n, reset_at, room, accepted) as (
        select user_id, i, event_id, sec, n, sec + 86400, case when n <= 400 then 400 - n else 400 end, n <= 400 from e where i = 1
        union all
        select e.user_id, e.i, e.event_id, e.sec, e.n, case when e.sec >= s.reset_at then e.sec + 86400 else s.reset_at end,
               case when e.n <= case when e.sec >= s.reset_at then 400 else s.room end then case when e.sec >= s.reset_at then 400 else s.room end - e.n else case when e.sec >= s.reset_at then 400 else s.room end end,
               e.n <= case when e.sec >= s.reset_at then 400 else s.room end
        from s join e on e.user_id = s.user_id and e.i = s.i + 1)
    select user_id, sec, event_id, n, accepted from s
    """
)
def rate_limit(spark, sf_dir):
    return folds.rate_limited(stream(spark, sf_dir), "user_id", ["sec", "event_id"], "sec", "n", budget=400, window=86400)


@query(
    FOLD.replace("cast(floor(value) as bigint) as n", "case when event_id % 3 = 0 then -1 else 1 end as n, event_id % 5 as sid")
    + """
    s(user_id, i, event_id, sec, sid, n, live, accepted) as (
        select user_id, i, event_id, sec, sid, n, case when n > 0 then [sid] else [] end, n > 0 from e where i = 1
        union all
        select e.user_id, e.i, e.event_id, e.sec, e.sid, e.n,
               case when e.n > 0 and len(s.live) < 3 then list_append(s.live, e.sid) when e.n > 0 then s.live else list_filter(s.live, lambda v: v <> e.sid) end,
               case when e.n > 0 then len(s.live) < 3 else list_contains(s.live, e.sid) end
        from s join e on e.user_id = s.user_id and e.i = s.i + 1)
    select user_id, sec, event_id, n, sid, accepted from s
    """
)
def admission_with_ends(spark, sf_dir):
    e = stream(spark, sf_dir).withColumn("n", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)).withColumn("sid", F.col("event_id") % 5)
    return folds.admitted(e, "user_id", ["sec", "event_id"], "n", "sid", most=3)


@query(
    """
    with p as (select l_orderkey, l_linenumber, l_quantity as x, l_discount * 100 as y from lineitem), t as (select *, greatest(0, least(1, ((x - 5) * 30 + (y - 2) * 6) / 936.0)) as t from p)
    select l_orderkey, l_linenumber, round(sqrt(power(x - (5 + t * 30), 2) + power(y - (2 + t * 6), 2)), 6) as distance,
           round(sqrt(power(x - greatest(12, least(x, 38)), 2) + power(y - greatest(4, least(y, 6)), 2)) - 2, 6) as box from t
    """
)
def distance_fields(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    near = raster.segment_distance(x, y, 5, 2, 35, 8)
    return li.select("l_orderkey", "l_linenumber", F.round(near, 6).alias("distance"), F.round(raster.rounded_box_distance(x, y, 10, 2, 40, 8, 2), 6).alias("box"))

"""The registered queries once more as SQL over the sample tables, for comparison."""

from __future__ import annotations

from freshet.plans.samples import NOW


def _name(key: str) -> str:
    return f"('s' || (({key}) % 10) || '.t' || ({key}))"


def _quoted(name: str) -> str:
    return f"""('"' || replace({name}, '.', '"."') || '"')"""


DEFS = f"""
defs as (
    select p_partkey as k, {_name('p_partkey')} as table_name,
        case when p_partkey < 2 then 'select 1 as id' else
            'select ' || case when p_partkey % 11 = 0 then '*' else 'a.id, a.v' || (p_partkey % 4) end
            || chr(10) || 'from '
            || case when p_partkey % 3 = 0 then {_quoted(_name('p_partkey // 2'))}
                else {_name('p_partkey // 2')} end
            || ' a' || chr(10) || chr(10) || 'join ' || {_quoted(_name('p_partkey // 3'))}
            || ' b on a.id = b.id -- not ' || {_name('p_partkey + 1')}
            || chr(10) || 'where b.id > 0;' || chr(10)
        end as query,
        cast(nullif(p_partkey % 5 * 360, 0) as integer) as "interval",
        case when p_partkey % 2 = 0 then 'v' || (p_partkey % 3) end as distkey,
        case p_partkey % 3 when 0 then 'id' when 1 then 'day' end as sortkey
    from part
)"""

CONFIG = """
case when distkey is not null or sortkey is not null then '{'
    || concat_ws(',', '"distkey":"' || distkey || '"', '"sortkey":"' || sortkey || '"') || '}' end
"""

EDGES = f"""{DEFS},
mentioned as (
    select distinct table_name as src, replace(unnest(regexp_extract_all(
        regexp_replace(query, '--[^\\n]*', '', 'g'), '"?\\w+"?\\."?\\w+"?')), '"', '') as dst
    from defs
),
edges as (select src, dst from mentioned where dst in (select table_name from defs))"""


def _catalog(source: str) -> str:
    return f"""
    select k, table_name, query, "interval", config,
        cast(case when k % 6 <> 0 then {NOW} - k % 5000 * 60 - k % 60 end as bigint) as last_created,
        cast(k % 300 as double) as mean,
        cast(k % 40 as integer) as times_run,
        cast(case k % 9 when 0 then 1 when 1 then 0 end as integer) as force,
        cast(case when k % 13 = 0 then {NOW} - k % 4000 end as bigint) as started,
        cast(case k % 17 when 0 then {NOW} - k % 20 * 86400 when 1 then 0 end as bigint) as deleted,
        cast(case k % 19 when 0 then {NOW} - k % 10000 when 1 then 0 end as bigint) as waiting
    from ({source})"""


CATALOG = "catalog as (" + _catalog(f"select *, {CONFIG} as config from defs") + ")"

CUSTOMERS = (
    "customers as ("
    + _catalog(
        f"""select c_custkey as k, {_name('c_custkey')} as table_name,
            'select * from base.' || lower(c_mktsegment) as query,
            cast(case c_custkey % 4 when 1 then 60 when 2 then 1440 when 3 then 30 end as integer)
                as "interval",
            cast(null as varchar) as config
        from customer"""
    )
    + ")"
)


def _steps() -> str:
    processed, done = "event_id % 4 = 0", "event_type <> 'error'"

    def at(base: int, spread: int, when: str = "true") -> str:
        return f"case when {when} then s + {base} + event_id % {spread} end"

    steps = {
        "start": "s",
        "connect": at(0, 3),
        "select": at(5, 7, processed),
        "create_temp": at(10, 11, f"not ({processed})"),
        "process": at(20, 13, processed),
        "csv": "null",
        "s3": "null",
        "insert": at(40, 17, processed),
        "clean_csv": "null",
        "tests": at(60, 19, done),
        "replace_old": at(90, 5, done),
        "drop_old": at(95, 23, done),
        "make_snapshot": at(130, 29, f"{done} and event_id % 6 = 0"),
        "finish": at(95, 23, done),
    }
    return ", ".join(f'cast({value} as bigint) as "{name}"' for name, value in steps.items())


STEP_NAMES = (
    "start connect select create_temp process csv s3 insert clean_csv tests replace_old drop_old make_snapshot"
).split()

RUNS = f"""
stamped as (select *, epoch_us(ts) // 1000000 as s from events),
runs as (select event_id as run_id, {_name('user_id')} as table_name, {_steps()} from stamped)"""

STEP_LABELS = [(name, name.replace("_", " ")) for name in STEP_NAMES]

_STEP_ROWS = " union all ".join(
    f"""select run_id, table_name, {i} as step_no, '{name}' as step, '{label}' as label, "{name}" as "at"
    from runs where "{name}" is not null"""
    for i, (name, label) in enumerate(STEP_LABELS)
)
STEPS = f"""{RUNS},
taken as ({_STEP_ROWS}),
steps as (
    select run_id, table_name, cast(step_no as integer) as step_no, step, label, "at",
        "at" - lag("at") over (partition by run_id order by step_no) as seconds
    from taken
)"""


def _duration(seconds: str) -> str:
    s = f"({seconds})"
    days = f"(case when {s} > 86400 then {s} // 86400 else 0 end)"
    rest = f"({s} - {days} * 86400)"
    return f"""case when {s} is null then '' when {s} < 60 then {s} || 's' else concat_ws(' ',
        case when {days} > 0 then {days} || 'd' end,
        case when {rest} >= 3600 or ({days} > 0 and {rest} > 0) then {rest} // 3600 || 'h' end,
        case when {rest} % 3600 >= 60 then {rest} % 3600 // 60 || 'm' end,
        case when {s} % 60 > 0 then {s} % 60 || 's' end) end"""


def _age(at: str) -> str:
    behind = f"({NOW} - ({at}))"
    size = f"abs({behind})"
    months = (
        f"abs((year(to_timestamp({NOW})) * 12 + month(to_timestamp({NOW})))"
        f" - (year(to_timestamp({at})) * 12 + month(to_timestamp({at}))))"
    )
    text = f"""case when {size} < 45 then 'seconds' when {size} < 90 then 'a minute'
        when {size} < 2700 then greatest({size} // 60, 2) || ' minutes'
        when {size} < 5400 then 'an hour'
        when {size} < 79200 then greatest({size} // 3600, 2) || ' hours'
        when {size} < 129600 then 'a day'
        when {size} < 2592000 then greatest({size} // 86400, 2) || ' days'
        when {size} < 3888000 then 'a month'
        when {size} < 29808000 then greatest({months}, 2) || ' months'
        when {size} < 47304000 then 'a year'
        else greatest({size} // 31536000, 2) || ' years' end"""
    return f"""case when {at} is null then '' when {size} < 10 then 'just now'
        when {behind} > 0 then ({text}) || ' ago' else 'in ' || ({text}) end"""


def _iso(at: str, separator: str = "T") -> str:
    return f"strftime(make_timestamp(({at}) * 1000000), '%Y-%m-%d{separator}%H:%M:%S') || '+00:00'"


SEGMENT_SALES = """
select c_mktsegment, count(*) as orders,
    cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as total
from orders join customer on o_custkey = c_custkey group by c_mktsegment"""

ORDER_COUNTS = """
select o_custkey, o_orderstatus, count(*) as orders,
    cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as total
from orders group by o_custkey, o_orderstatus"""

FILES = f"""
files as (
    select p_partkey as k, {_name('p_partkey')} as table_name,
        's' || (p_partkey % 10) || '/t' || p_partkey as inside,
        's' || (p_partkey % 10) || '.t' || p_partkey as beside,
        p_partkey % 12 <> 7 as has_query, p_partkey % 3 = 1 as has_test,
        p_partkey % 5 = 0 as has_processor,
        p_partkey % 10 = 0 or p_partkey % 14 = 7 as has_select,
        p_partkey % 25 = 0 as has_requirements,
        case p_partkey % 4 when 1 then 1440 when 2 then 30 when 3 then 10080 end as minutes
    from part
),
names as (
    select case k % 4 when 0 then inside || '.sql' when 1 then beside || ' — 24h.sql'
            when 2 then inside || ' - 30m.sql' else inside || '–1W.sql' end as path,
        case when has_processor then 'ddl' else 'query' end as kind, table_name,
        cast(minutes as bigint) as minutes,
        case when not has_processor then 'select 1 as id'
            when has_select then case when k % 30 = 0 then '' else 'select id from s1.t1' end end as query
    from files where has_query
    union all
    select beside || '_select.sql', 'query', table_name || '_select', null,
        case when k % 30 = 0 then '' else 'select id from s1.t1' end
    from files where has_select and not has_processor
    union all
    select beside || '_select.sql', 'select', table_name, null, null
    from files where has_select and has_processor
    union all
    select inside || '_test.sql', 'test', table_name, null, null from files where has_test
    union all
    select inside || '.py', 'processor', table_name, null, null from files where has_processor
    union all
    select inside || '_requirements.txt', 'requirements', table_name, null, null
    from files where has_requirements
),
missing as (
    select 'test without query' as check_name, table_name from files where has_test and not has_query
    union all
    select 'processor without select', table_name from files
    where has_processor and not (has_select and k % 30 <> 0)
    union all
    select 'processor without ddl', table_name from files where has_processor and not has_query
)"""


def _lines(source: str, group: str) -> str:
    return f"""
    select {group}, place // 1000 as line,
        string_agg(table_name, ', ' order by place) as names, count(*) as n
    from (select {group}, table_name,
        row_number() over (partition by {group} order by table_name) - 1 as place from {source})
    group by 1, 2"""


CHANGED = f"""
changed as (
    select table_name, query || case when k % 7 = 0 then chr(10) || 'limit 10' else '' end as query,
        case when k % 10 = 3 then 30 else "interval" end as "interval", {CONFIG} as config
    from defs where k % 13 <> 0
    union all
    select table_name || '_next', query, "interval", {CONFIG} from defs where k % 9 = 0
)"""

COMPARED = f"""{DEFS}, {CATALOG}, {CHANGED},
compared as (
    select table_name, o.table_name is not null as is_old, n.table_name is not null as is_new,
        coalesce(o.deleted, 0) <> 0 as was_deleted,
        o.query is not distinct from n.query and o."interval" is not distinct from n."interval"
            and o.config is not distinct from n.config as same,
        o.*  exclude (table_name, "interval"), n."interval" as new_interval, o."interval" as old_interval
    from (select *, table_name as t from catalog) o
    full join (select *, table_name as t from changed) n using (table_name)
),
diff as (
    select *, case when not is_old then 'new' when not is_new and was_deleted then 'gone'
        when not is_new then 'deleted' when not same then 'updated'
        when was_deleted then 'revived' else 'unchanged' end as status
    from compared
)"""


def _decision(interval: str) -> str:
    """Text of the reason; the table is built unless it reads waiting, running or fresh."""
    return f"""case
        when coalesce(waiting, 0) <> 0 and not {NOW} - waiting > 7200 then 'waiting'
        when coalesce(started, 0) <> 0 and mean > 0 and not {NOW} - started > 5 * mean then 'running'
        when coalesce(force, 0) <> 0 then 'forced'
        when last_created is null then 'never built'
        when {interval} is null then 'no interval'
        when ({NOW} - last_created) / 60.0 <= {interval} then 'fresh'
        else 'stale' end"""


_BUILT = "not in ('waiting', 'running', 'fresh')"

_IN_QUEUE = f"""(coalesce(force, 0) = 1 or last_created is null
    or coalesce(({NOW} - last_created) // 60 - "interval" > 0, false)) and coalesce(deleted, 0) = 0"""

_APPLIES = 'coalesce(nullif("interval", 0), asked)'


def _live_runs() -> str:
    return f"with {RUNS}, {CUSTOMERS}"


def oracle_sql() -> dict[str, str]:
    sql = {
        "mv_rebuild": SEGMENT_SALES,
        "mv_layout_bucketed": f"""select counts.*, c_mktsegment from ({ORDER_COUNTS}) counts
            join customer on o_custkey = c_custkey""",
        "mv_publish_versions": f"""with counts as ({ORDER_COUNTS}),
            totals as (
                select count(*) as whole, count(*) filter (o_orderstatus = 'F') as finished,
                    count(*) filter (orders > 1) as repeated from counts)
            select publish, step, live_rows, begun_rows, 2 as stored_versions from totals, lateral (values
                (0, 'built', null, null), (0, 'pointed', finished, null), (0, 'retired', finished, null),
                (1, 'built', finished, finished), (1, 'pointed', whole, finished), (1, 'retired', whole, finished),
                (2, 'built', whole, whole), (2, 'pointed', repeated, whole), (2, 'retired', repeated, whole)
            ) steps(publish, step, live_rows, begun_rows)""",
        "mv_dependent_chain": f"""select *, orders % 2 as odd, total / orders > 100000 as large,
            'spent' as refused from ({ORDER_COUNTS}) where orders > 1""",
        "folder_scan": f"""with {FILES},
            written as (
                select case k % 4 when 0 then inside || '.sql' when 1 then beside || ' — 24h.sql'
                    when 2 then inside || ' - 30m.sql' else inside || '–1W.sql' end as path, 'select 1 as id' as text
                from files where has_query
                union all select inside || '_test.sql', 'select true as ok' from files where has_test
                union all select inside || '.py', 'pass' from files where has_processor
                union all select beside || '_select.sql', case when k % 30 = 0 then '' else 'select id from s1.t1' end
                from files where has_select
                union all select inside || '_requirements.txt', 'x==1' from files where has_requirements)
            select path, case when path not like '%13%' then
                    text || case when path like '%7%' then chr(10) || '-- edited' else '' end end as text,
                case when path like '%13%' then 'gone' when path like '%7%' then
                    case when text = '' then 'new' else 'changed' end else 'same' end as status
            from written where text <> '' or path like '%7%' and path not like '%13%'
            union all select 'more/' || path, text, 'new' from written where path like '%42%' and text <> ''""",
        "folder_replan": f"""with recursive defs as (
                select p_partkey as k, {_name('p_partkey')} as table_name,
                    case when p_partkey % 7 = 3 then p_partkey // 2 else p_partkey end as base
                from part where p_partkey % 13 <> 5),
            tables as (
                select table_name from defs
                union all select {_name('p_partkey')} || '_next' from part where p_partkey % 9 = 0),
            named as (
                select table_name as src, {_name('base // 2')} as dst from defs where base >= 2
                union select table_name, {_name('base // 3')} from defs where base >= 2
                union select {_name('p_partkey')} || '_next', {_name('p_partkey')} from part where p_partkey % 9 = 0),
            edges as (select src, dst from named where dst in (select table_name from tables)),
            walks as (
                select table_name, 0 as level from tables
                union select src, level + 1 from walks join edges on dst = table_name where src <> dst),
            reading as (select src as table_name, string_agg(dst, ', ' order by dst) as reads from edges group by 1)
            select table_name, max(level) as level, any_value(reads) as reads,
                case when substr(table_name, 2, 1) = '3' then '{{"diststyle":"even"}}'
                    when substr(table_name, 2, 1) in ('0', '9', '4') then '{{"diststyle":"all"}}' end as config
            from walks left join reading using (table_name) group by table_name""",
        "mv_layout_sorted": """select event_id, user_id, event_type, value, n_name
            from events join nation on n_nationkey = user_id % 25""",
        "mv_delimited_roundtrip": """select doc_id,
                case when doc_id % 3 <> 0 then nullif(trim(lang), '') end as lang,
                case when trim(source) <> '' then source end as source,
                case when trim(text) <> '' then text end as text, n_chars
            from documents""",
        "mv_processor": """select o_orderkey as order_key, lower(o_orderstatus) as status,
            cast(round(o_totalprice * 100) as bigint) as cents from orders""",
        "mv_rebuild_set": """select * from (values
                ('order_counts', 0, 'built', '', 1, {0}, null, cast(1 as bigint), cast(1 as bigint)),
                ('totals', 1, 'built', '', 1, {0}, null, 1, 1),
                ('refused', 2, 'failed', 'too_strict', 0, cast(null as bigint), 1, 1, 0))
                outcomes(table_name, level, status, failed_test, times_run, last_created, force, logged, tested)
            left join (
                select 'totals' as table_name, count(distinct o_custkey) as row_count,
                    count(*) as orders from orders
            ) totals using (table_name)""".format(NOW),
        "data_test_results": """
            select 'unique_orders' as test_name, count(*) = count(distinct o_orderkey) as passed from orders
            union all select 'positive_prices', min(o_totalprice) > 0 from orders
            union all select 'all_cheap', max(o_totalprice) < 100 from orders
            union all select 'no_such_order', count(*) > 0 from orders where o_orderkey < 0
            union all select 'unknown', false""",
        "data_tests_observed": f"""with counts as ({ORDER_COUNTS})
            select 'some_orders' as test_name, min(orders) > 0 as passed, true as observed from counts
            union all select 'some_money', sum(total) > 0 and count(*) > 1, true from counts
            union all select 'never_again', max(orders) < 2, true from counts
            union all select 'three_states', count(distinct o_orderstatus) = 3, false from counts
            union all select 'no_such_state', count(*) > 0, false from counts where o_orderstatus = 'X'
            union all select 'mean_is_true', cast(avg(total) as boolean), true from counts""",
        "row_expectations": """
            select 'quantity_positive' as test_name, bool_and(l_quantity > 0) as passed,
                count(*) filter (not l_quantity > 0) as failed_rows from lineitem
            union all select 'small_discount', bool_and(l_discount <= 0.05),
                count(*) filter (not l_discount <= 0.05) from lineitem
            union all select 'known_flag', bool_and(l_returnflag in ('A', 'N', 'R')),
                count(*) filter (l_returnflag not in ('A', 'N', 'R')) from lineitem""",
        "snapshot_history": f"""select counts.*, snapshot_timestamp from ({ORDER_COUNTS}) counts,
            (values (cast({NOW} as bigint)), ({NOW + 25 * 3600}), ({NOW + 50 * 3600}))
                taken(snapshot_timestamp)""",
        "snapshot_prune": f"""select counts.*, snapshot_timestamp from ({ORDER_COUNTS}) counts,
            (values (cast({NOW + 25 * 3600} as bigint)), ({NOW + 50 * 3600})) taken(snapshot_timestamp)""",
        "snapshot_drift": f"""select counts.*, cast(null as bigint) as first_key,
                cast({NOW} as bigint) as snapshot_timestamp from ({ORDER_COUNTS}) counts
            union all select o_custkey, null, count(*), null, cast(min(o_orderkey) as bigint),
                {NOW + 25 * 3600} from orders group by o_custkey""",
        "mv_dependent_refresh": f"select * from ({ORDER_COUNTS}) counts where orders > 1",
        "mv_view_to_table": f"select counts.*, false as is_view from ({ORDER_COUNTS}) counts",
        "test_discovery": f"""select {_name('p_partkey')} as table_name, 'select true as ok' as text
            from part where p_partkey % 3 = 1""",
        "dependency_edges_hot_key": f"""with {DEFS}, reads as (
                select table_name as src, 's0.t0' as dst from defs where k % 3 <> 0
                union select table_name, {_name('k // 2')} from defs where k % 3 <> 0)
            select src, dst from reads where dst in (select table_name from defs)""",
        "dependency_edges": f"with {EDGES} select src, dst from edges",
        "readers_of_table": f"""with {DEFS} select table_name from defs where regexp_matches(
            regexp_replace(query, '--[^\\n]*', '', 'g'), '\\b"?s1"?\\."?t1"?\\b')""",
        "comment_free_text": f"""with {DEFS} select table_name,
                regexp_replace(rtrim(regexp_replace(query, '\\n\\n+', chr(10), 'g'), chr(10)),
                    '--[^\\n]*', '', 'g') as clean,
                rtrim(query, ';' || chr(10)) as statement
            from defs""",
        "graph_sources": f"""with {EDGES} select table_name as node from defs
            where table_name not in (select dst from edges)""",
        "sources_without_interval": f"""with {EDGES} select table_name as node from defs
            where table_name not in (select dst from edges) and coalesce("interval", 0) = 0""",
        "graph_in_degrees": f"with {EDGES} select dst as node, count(*) as in_degree from edges group by dst",
        "graph_children": f"with {EDGES} select dst as node from edges where src = 's9.t99'",
        "graph_reachable": f"""with recursive {EDGES}, {CATALOG},
            reached as (
                select table_name as node from catalog where started is not null
                union select dst from reached join edges on src = node
            ) select node from reached""",
        "graph_cycles": f"""with recursive {EDGES},
            linked as (
                select src, dst from edges
                union select {_name('k // 2')}, table_name from defs where k > 0 and k % 97 = 0
            ),
            paths as (
                select src as first, [src] as path, dst as next from linked where dst >= src
                union all
                select first, list_append(path, next), l.dst from paths join linked l on l.src = next
                where next <> first and not list_contains(path, next) and l.dst >= first
            )
            select array_to_string(path, ' > ') as cycle, cast(len(path) as integer) as length
            from paths where next = first""",
        "graph_strong_components": f"""with recursive {EDGES},
            linked as (
                select src, dst from edges
                union select {_name('k // 2')}, table_name from defs where k > 0 and k % 97 = 0
                union select d.table_name, other.table_name from defs d, defs other where d.k < 50 and other.k < 50
            ),
            walks as (
                select src, dst from linked union select w.src, l.dst from walks w join linked l on l.src = w.dst
            ),
            named as (
                select table_name as node, least(table_name, coalesce(min(there.dst), table_name)) as component
                from defs left join (
                    select a.src, a.dst from walks a join walks b on a.src = b.dst and a.dst = b.src
                ) there on there.src = table_name
                group by table_name
            ),
            links as (
                select distinct a.component as src, b.component as dst
                from linked join named a on a.node = linked.src join named b on b.node = linked.dst
                where a.component <> b.component
            ),
            steps as (
                select component, 0 as level from named
                union select src, level + 1 from steps join links on dst = component
            )
            select node, component, size, level from named
            join (select component, count(*) as size from named group by component) using (component)
            join (select component, max(level) as level from steps group by component) using (component)""",
        "force_propagation": f"""with recursive {EDGES}, {CATALOG},
            reached as (
                select table_name as node from catalog where started is not null
                union select dst from reached join edges on src = node
            )
            select table_name, case when table_name in (select node from reached) then 1 else force end
                as force
            from catalog""",
        "definition_names": f"with {FILES} select path, kind, table_name, minutes from names",
        "definitions_from_files": f"""with {FILES} select table_name, query,
                cast(minutes as integer) as "interval"
            from names where kind in ('query', 'ddl')""",
        "definition_lookup": f"""with {RUNS}, {FILES},
            known as (select table_name, cast(minutes as integer) as "interval", true as found
                from names where kind in ('query', 'ddl'))
            select table_name, "interval", coalesce(found, false) as found
            from (select distinct table_name from runs) left join known using (table_name)""",
        "missing_files": f"with {FILES} select check_name, table_name from missing",
        "missing_files_report": f"with {FILES} {_lines('missing', 'check_name')}",
        "layout_key_check": f"""with {DEFS},
            keys as (
                select table_name, query, 'distkey' as setting, distkey as key from defs
                union all select table_name, query, 'sortkey', sortkey from defs
            )
            select table_name, setting, key from keys
            where key is not null and not contains(query, key) and not contains(query, '*')""",
        "layout_column_check": f"""with {DEFS},
            keys as (
                select k, table_name, 'distkey' as setting, distkey as key from defs
                union all select k, table_name, 'sortkey', sortkey from defs
            )
            select table_name, setting, key from keys
            where key is not null and key not in ('id', 'v' || (k % 4))""",
        "config_codec": f"with {DEFS} select table_name, distkey, sortkey, {CONFIG} as encoded from defs",
        "effective_settings": f"""
            with rows as (
                select {_name('s_suppkey')} as table_name, level, ['distkey', 'sortkey', 'diststyle'][j + 1] as key,
                    (s_suppkey * 3 + level * 5 + j * 7 + s_suppkey // 10) % 6 as pick, s_suppkey as k
                from supplier, range(5) l(level), range(3) js(j)
            ),
            ranked as (
                select *, row_number() over (partition by table_name, key order by level desc) as n
                from rows where pick < 4
            )
            select table_name, key,
                case pick when 2 then 'col' || level when 3 then 'c' || (k % 7) end as value
            from ranked where n = 1""",
        "effective_grants": f"""
            with picks as (
                select {_name('s_suppkey')} as table_name, level,
                    (s_suppkey + level + s_suppkey // 6 * level) % 6 as pick
                from supplier, range(5) l(level)
            ),
            acl as (
                select table_name, level, case pick when 1 then 'ann, bob' when 2 then '+cy'
                    when 3 then '-ann' when 4 then '+dan, -bob' when 5 then '' end as value from picks
            ),
            entries as (
                select table_name, level, not regexp_matches(value, '[+-]') as replaces,
                    unnest(string_split(replace(value, ' ', ''), ',')) as entry
                from acl where value <> ''
            ),
            floors as (
                select table_name, max(level) filter (replaces) as base from entries group by table_name
            ),
            ops as (
                select table_name, level, ltrim(entry, '+-') as who, entry like '-%' as removed
                from entries join floors using (table_name) where level >= coalesce(base, 0)
            ),
            last_ops as (
                select table_name, who, arg_max(removed, level * 2 + removed::integer) as removed
                from ops group by table_name, who
            )
            select table_name, coalesce(string_agg(who, ', ' order by who) filter (not removed), '')
                as grantees
            from (select distinct table_name from acl) left join last_ops using (table_name)
            group by table_name""",
        "scoped_settings": f"""with {DEFS} select table_name,
                case when k % 12 = 0 then null when k % 6 = 0 then 'key'
                    when k % 10 < 5 then 'even' else 'all' end as diststyle
            from defs""",
        "definition_diff": f"with {COMPARED} select table_name, status from diff",
        "definition_deleted": f"""with {COMPARED} select table_name,
                case when is_new then new_interval else old_interval end as "interval",
                case when status = 'new' then 0.0::double else mean end as mean,
                case when status = 'new' then 0 else times_run end as times_run,
                case when status in ('new', 'updated', 'revived') then 1
                    when status <> 'deleted' then force end as force,
                case when status <> 'deleted' then started end as started,
                cast(case status when 'deleted' then {NOW} when 'gone' then deleted end as bigint)
                    as deleted,
                case when status <> 'deleted' then waiting end as waiting
            from diff""",
        "diff_summary": f"with {COMPARED} {_lines('diff', 'status')}",
        "change_notice": f"""with {COMPARED} select status, line,
                case status when 'new' then 'New tables: ' else 'Updated tables: ' end || names || '.'
                    as notice
            from ({_lines('diff', 'status')}) where status in ('new', 'updated')""",
        "flag_updates": f"""{_live_runs()}
            select table_name, cast(case when table_name in (select table_name from runs)
                    then {NOW} else started end as bigint) as started,
                cast(case when table_name in (select table_name from runs where make_snapshot is not null)
                        then 0
                    when table_name in (select table_name from runs where "insert" is not null)
                        then {NOW} else waiting end as bigint) as waiting,
                cast(null as integer) as force
            from customers""",
        "recorded_builds": f"""{_live_runs()},
            batch as (
                select table_name, max("start") as last_start, sum(finish - "start") as total, count(*) as n
                from runs where finish is not null group by table_name
            )
            select table_name, coalesce(last_start, last_created) as last_created,
                round(case when n is null then mean
                    else (mean * times_run + total) / (times_run + n) end, 6) as mean,
                cast(times_run + coalesce(n, 0) as integer) as times_run,
                case when n is null then force end as force,
                case when n is null then started end as started,
                case when n is null then waiting end as waiting
            from customers left join batch using (table_name)""",
        "catalog_listing": f"""with {CUSTOMERS}
            select table_name, "interval", last_created, mean, started, deleted, force from customers
            where coalesce(deleted, 0) = 0 or ({NOW} - deleted) // 86400 < 7""",
        "refresh_queue": f"with {CUSTOMERS} select table_name, force from customers where {_IN_QUEUE}",
        "refresh_decision": f"""with {CUSTOMERS},
            reasons as (select table_name, {_decision('"interval"')} as reason from customers)
            select table_name, reason {_BUILT} as build, reason from reasons""",
        "waiting_status": f"""with {CUSTOMERS} select table_name, coalesce(waiting, 0) <> 0 as waiting,
                coalesce(waiting <> 0 and {NOW} - waiting > 7200, false) as too_long
            from customers""",
        "overdue_runs": f"""with {CUSTOMERS} select table_name, started,
                {NOW} - started as running_seconds, 5 * mean as bound_seconds
            from customers where started is not null and mean > 0 and {NOW} - started > 5 * mean""",
        "refresh_plan": f"""with recursive {EDGES}, {CATALOG},
            state as (select * from catalog where coalesce(deleted, 0) = 0),
            planned as (
                select table_name, cast(nullif("interval", 0) as integer) as applies from state
                where {_IN_QUEUE} and {_decision('nullif("interval", 0)')} {_BUILT}
                union
                select s.table_name, cast(s.applies as integer) from (
                    select state.*, planned.applies as asked, {_APPLIES.replace('asked', 'planned.applies')}
                        as applies
                    from planned join edges on src = planned.table_name
                    join state on state.table_name = dst
                ) s where {_decision('s.applies')} {_BUILT}
            ),
            wanted as (
                select table_name, case when bool_or(applies is null) then null else min(applies) end
                    as "interval"
                from planned group by table_name
            ),
            links as (
                select src, dst from edges
                where src in (select table_name from wanted) and dst in (select table_name from wanted)
            ),
            leveled as (
                select table_name, 0 as level from wanted
                union select src, level + 1 from leveled join links on dst = table_name
            )
            select table_name, "interval", cast(max(level) as integer) as level
            from wanted join leveled using (table_name) group by table_name, "interval" """,
        "run_log_append": f"with {RUNS} select * exclude (run_id) from runs",
        "overview_stats": f"""with {RUNS} select count(distinct table_name) as tables, count(*) as updates,
                round(cast(sum(finish - "start") as double) * 100.0 / (240 * 3600), 2) as load
            from runs where ({NOW} - finish) // 3600 < 240""",
        "running_mean": f"""with {RUNS} select table_name, "start", finish,
                cast(sum(finish - "start") over w as double) / count(*) over w as mean,
                count(*) over w as times_run
            from runs where finish is not null
            window w as (partition by table_name order by "start" range between unbounded preceding
                and current row)""",
        "table_stats": f"""with {RUNS} select table_name,
                cast(sum(finish - "start") as double) / count(*) as mean, count(*) as times_run,
                max("start") as last_created
            from runs where finish is not null group by table_name""",
        "jobs_window": f"""{_live_runs()},
            listed as (
                select table_name, "start", coalesce(drop_old, "insert") as finish from runs
                where "start" between {NOW - 20 * 86400} and {NOW - 86400}
                union all
                select table_name, started, null from customers
                where started is not null and coalesce(deleted, 0) = 0
            )
            select table_name, {_iso('"start"')} as "start", {_iso('finish')} as finish from listed""",
        "table_details_topk": f"""{_live_runs()},
            ranked as (
                select *, row_number() over (partition by table_name
                    order by finish desc nulls last, "start" desc nulls last) as rank
                from runs
            )
            select customers.table_name, "interval", "start", finish, cast(rank as integer) as rank
            from customers left join ranked
                on ranked.table_name = customers.table_name and rank <= 20""",
        "step_durations": f'with {STEPS} select run_id, table_name, step_no, step, "at", seconds from steps',
        "step_texts": f"""with {STEPS} select run_id, step_no,
                case when step = 'start'
                    then strftime(make_timestamp("at" * 1000000), '%A, %B %d, %H:%M:%S')
                    else strftime(make_timestamp("at" * 1000000), '%H:%M:%S') || ': ' || label
                        || ' (' || {_duration('seconds')} || ')' end as line
            from steps""",
        "duration_series": f"""with {RUNS} select run_id, table_name, "start",
                {_iso('"start"', ' ')} as date, finish - "start" as duration
            from runs where "start" is not null""",
        "throttled_events": """with recursive stamps as (
                select user_id, epoch_us(ts) as moment, min(event_id) as event_id from events group by 1, 2
            ),
            kept as (
                select user_id, min(moment) as moment from stamps group by user_id
                union all
                select kept.user_id, min(stamps.moment) from kept join stamps
                    on stamps.user_id = kept.user_id and stamps.moment >= kept.moment + 86400000000
                group by kept.user_id
            )
            select event_id, user_id, moment as "at" from kept join stamps using (user_id, moment)""",
        "throttled_stream": """with recursive
            kept as (
                select user_id, min(epoch_us(ts)) as moment from events group by user_id
                union all
                select kept.user_id, min(epoch_us(ts)) from kept join events
                    on events.user_id = kept.user_id and epoch_us(ts) >= kept.moment + 86400000000
                group by kept.user_id
            )
            select user_id, moment as "at" from kept""",
        "duration_text": f"""
            with s as (select *, cast(floor(o_totalprice) as bigint) as seconds from orders)
            select o_orderkey, {_duration('seconds')} as duration,
                concat_ws(' ', case when seconds // 60 > 0 then seconds // 60 || 'm' end,
                    case when seconds % 60 > 0 then seconds % 60 || 's' end) as minutes,
                {_duration('o_custkey * 60')} as interval_text,
                {_duration('cast(round_even(o_totalprice / 50, 0) as bigint)')} as mean_text
            from s""",
        "interval_minutes": """select p_partkey, case when p_partkey % 7 <> 0 then
                p_size * [1, 60, 1440, 10080, 1, 60][p_partkey % 6 + 1]::bigint end as minutes,
                cast(null as bigint) as not_an_interval
            from part""",
        "epoch_text": f"""
            with s as (
                select *, case when event_type <> 'error' then epoch_us(ts) // 1000000 end as moment from events
            )
            select event_id,
                coalesce(strftime(make_timestamp(moment * 1000000), '%A, %B %d, %H:%M:%S'), '') as long_text,
                coalesce(strftime(make_timestamp(moment * 1000000), '%H:%M:%S'), '') as clock,
                coalesce({_iso('moment')}, '') as iso, {_age('moment')} as age,
                case when event_type = 'view' then event_type else '' end as blank
            from s""",
        "age_text": f"""
            with s as (
                select o_orderkey, {NOW} - (o_orderkey % 3 - 1) * (o_orderkey * o_orderkey % 100000007)
                    as moment from orders
            )
            select o_orderkey, {_age('moment')} as age from s""",
    }
    return sql

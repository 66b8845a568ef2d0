"""Log diagnosis: a user's events are a log, every event one or more lines that programs print."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import diagnose
from .registry import plan, table

#: What events print, by their number; {} is filled with it.
PRINTED = (
    "step {} done", "reading file_{}.slc", "HTTP 503: busy {}", "403 Client Error for job {}", "proj: Cannot find proj.db in /opt/{}", "Killed: 9", "snaphu v2.0.{}", "Cannot allocate memory ({})",
    "These jobs would cost {}.5 credits, but you have only {} remaining", "Burst IDs do not match for A{} and B{}.", "Only VV and HH polarizations are currently supported, got: VH", "Some requested scenes do not have DEM coverage: S{}, T{}",
    "request for access is pending review", "No common bursts found for swath 2", "No swaths contain any burst overlaps", "Coherence threshold too strict. No points left for reliable ESD estimate", "Failed to find POEORB orbits for tref",
    "Unknown reference system for DEM: {}", "No acquisition fulfills the temporal range and bbox requirement", "No pixel with average spatial coherence > 0.{} are found for automatic reference point selection", "Not enough reliable pixels (minimum of {})",
    "PYAPS: No account info found for {}", "input reference point is in masked OUT area", "Exceeded maximum number of secondary nodes", "Out of memory", "Minimum region size cannot exceed tile size",
    "Traceback (most recent call last):\\n  File a.py, line {}\\n\\n    run()\\nValueError: bad {}", "Traceback (most recent call last):\\n  File b.py", "builtins.KeyError", "Command 'x {}' returned non-zero exit status 1.",
    "2024 ERROR: {}", "Abort", "mintpy.network.x {}", "HyP3 INSAR job 0a{}", "isce.topsinsar {}", "asf_search {}", "ok\\r\\nnext {}", "plain {}",
)
N = len(PRINTED)
NAMES = ("run_unwrap.log", "smallbaselineapp.txt", "job.log", "hyp3/cmr.out")
_LINES = ", ".join("'" + p.replace("'", "''") + "'" for p in PRINTED)
_UN = lambda c: f"replace(replace(replace({c}, '\\n', chr(10)), '\\r', chr(13)), '{{}}', cast(event_id as varchar))"

LOGS = f"""logs as (select user_id, (['{"', '".join(NAMES)}'])[user_id % {len(NAMES)} + 1] as name,
    replace(replace(string_agg(line, chr(10) order by event_id), chr(13) || chr(10), chr(10)), chr(13), chr(10)) as t
  from (select user_id, event_id, {_UN(f"([{_LINES}])[(event_id * 7 + user_id) % {N} + 1]")} as line from events) group by 1)"""


def logs(spark, sf_dir):
    """(user_id, name, text): one log a user, of at most a few hundred lines."""
    k = ((F.col("event_id") * 7 + F.col("user_id")) % N).cast("int")
    line = F.get(F.array(*[F.lit(p.replace("\\n", "\n").replace("\\r", "\r")) for p in PRINTED]), k)
    e = table(spark, sf_dir, "events").select("user_id", F.struct("event_id", F.replace(line, F.lit("{}"), F.col("event_id").cast("string")).alias("line")).alias("e"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["line"]), "\n")
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("user_id") % len(NAMES)).cast("int"))
    return e.groupBy("user_id").agg(text.alias("text")).select("user_id", name.alias("name"), "text")


def _q(p: str) -> str:
    return p.replace("'", "''")


def _entry(k: int, e) -> str:
    groups = re.compile(e.pattern).groupindex
    some = " || ".join(f"coalesce('{g}=' || list_filter(regexp_extract_all(t, '(?m){_q(e.pattern)}', {n}), lambda x: x <> '')[1] || ';', '')" for g, n in groups.items()) or "''"
    return f"""select user_id, name, '{e.name}' as entry, '{e.engine}' as kb, '{e.stage}' as stage,
      cast(length(regexp_replace(regexp_extract(t, '(?s)\\A(.*?)(?-s:(?m:{_q(e.pattern)}))', 1), '[^\n]', '', 'g')) + 1 as bigint) as line_no,
      cast(len(regexp_extract_all(t, '(?m){_q(e.pattern)}')) as bigint) as count, {some} as params from logs where regexp_matches(t, '(?m){_q(e.pattern)}')"""


ALL = f"{LOGS}, hits as ({' union all '.join(_entry(k, e) for k, e in enumerate(diagnose.KNOWLEDGE))})"


def _shown(df):
    some = F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), "")
    return df.withColumn("params", some)


_CONTEXT = "array_to_string((string_split(t, chr(10)))[greatest(line_no - {a}, 1):line_no + {b}], chr(10))"


@plan(f"""with {ALL} select user_id, entry, line_no, count, params, {_CONTEXT.format(a=3, b=3)} as context from hits join logs using (user_id)
  where not (entry = 'KB-ENV-002' and user_id in (select user_id from hits where entry = 'KB-SNAPHU-002'))""")
def knowledge_base_matches(spark, sf_dir):
    found = diagnose.matches(logs(spark, sf_dir), "user_id", "text")
    return _shown(found).select("user_id", "entry", "line_no", "count", "params", "context")


_KIND = " ".join(f"when regexp_matches(line, '{_q(p)}') then '{k}'" for k, p in diagnose.EVENTS)
FOUND_EVENTS = f"""l as (select user_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as line_no, len(string_split(t, chr(10))) as n from logs),
  starts as (select user_id, line_no as s, n from l where regexp_matches(line, '{_q(diagnose.TRACEBACK)}')),
  anchors as (select distinct s.user_id, coalesce((select min(l.line_no) from l where l.user_id = s.user_id and l.line_no > s.s and not regexp_matches(l.line, '^[ \\t]') and trim(l.line) <> ''), least(n, s.s + 1)) as line_no from starts s),
  ev as (select l.user_id, cast(l.line_no as bigint) as line_no, case when a.line_no is not null then 'traceback' {_KIND} end as kind, line from l left join anchors a on a.user_id = l.user_id and a.line_no = l.line_no)"""


@plan(f"""with {LOGS}, {FOUND_EVENTS} select user_id, line_no, kind, line, case when kind = 'traceback' then {_CONTEXT.format(a=6, b=1)} else {_CONTEXT.format(a=3, b=3)} end as context from ev join logs using (user_id) where kind is not null""")
def failure_events(spark, sf_dir):
    return diagnose.events(logs(spark, sf_dir), "user_id", "text")


def _score(ms):
    return " + ".join(f"least(len(regexp_extract_all(t, '{_q(m)}')), {diagnose.MOST_HITS})" for m in ms)


_SAID = ", ".join(f"case when {' or '.join(f'contains(lower(name), {chr(39)}{h}{chr(39)})' for h in hs)} then '{n}' end" for n, hs in diagnose.ENGINE_NAMES.items())
ENGINES = f"""sc as (select user_id, [{', '.join(f"{{'score': {_score(ms)}, 'engine': '{n}'}}" for n, ms in diagnose.ENGINE_MARKERS.items())}] as s,
    list_filter([{_SAID.replace('lower(name)', "lower(string_split(name, '/')[-1])")}], lambda x: x is not null) as hits from logs),
  said as (select user_id, s, case when len(hits) = 1 then hits[1] end as said, list_max(list_transform(s, lambda x: x.score)) as top from sc),
  eng as (select user_id, case when len(list_filter(s, lambda x: x.engine = said and x.score > 0)) > 0 then said
    when top > 0 and len(list_filter(s, lambda x: x.score = top)) = 1 then list_filter(s, lambda x: x.score = top)[1].engine else said end as engine from said)"""


@plan(f"with {LOGS}, {ENGINES} select user_id, engine from eng")
def engine_detection(spark, sf_dir):
    return diagnose.engine_scores(logs(spark, sf_dir), "user_id", "text", name="name")


FINDINGS = f"""{ALL}, {ENGINES}, {FOUND_EVENTS},
  own as (select h.*, engine, engine is null or kb = 'any' or kb = engine as mine from hits h join eng using (user_id)),
  used as (select * from own where mine or user_id not in (select user_id from own where mine)),
  known as (select * from used where not (entry = 'KB-ENV-002' and user_id in (select user_id from used where entry = 'KB-SNAPHU-002'))),
  found as (select user_id, entry as rule, 'FAIL' as severity, coalesce(engine, kb) as engine, stage, line_no, count, params from known
    union all select user_id, 'KB-UNKNOWN', 'WARN', engine, null, min(line_no), count(*), '' from ev join eng using (user_id) where kind is not null and user_id not in (select user_id from known) group by user_id, engine)"""


@plan(f"with {FINDINGS} select * from found")
def diagnosis_findings(spark, sf_dir):
    return _shown(diagnose.findings(logs(spark, sf_dir), "user_id", "name", "text"))


_HINTS = ", ".join(f"('{e.name}', '{e.hint_stage or e.stage}', '{e.action}')" for e in diagnose.KNOWLEDGE if e.action)


@plan(f"""with {FINDINGS}, hints(rule, hint_stage, action) as (values {_HINTS}) select user_id, arg_min(rule, (case severity when 'FAIL' then 0 else 1 end, rule)) as rule,
    arg_min(hint_stage, (case severity when 'FAIL' then 0 else 1 end, rule)) as stage, arg_min(action, (case severity when 'FAIL' then 0 else 1 end, rule)) as action from found join hints using (rule) group by 1""")
def retry_hints(spark, sf_dir):
    return diagnose.retry_hints(diagnose.findings(logs(spark, sf_dir), "user_id", "name", "text"), "user_id")


@plan("""with l as (select conv_id, turn, text, lag(text) over w as before, lead(text) over w as after from conversations window w as (partition by conv_id order by turn))
  select conv_id, turn, length(coalesce(before, '')) + length(text) + length(coalesce(after, '')) as context_chars from l where text like '%the%'""")
def context_lines(spark, sf_dir):
    """Rows around each hit, by position."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 1)
    c = table(spark, sf_dir, "conversations").withColumn("context_chars", F.sum(F.length("text")).over(w))
    return c.where("text like '%the%'").select("conv_id", "turn", "context_chars")

"""Queries of the general data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, asknown, intervals, regrid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asknown.active_at_target(table(spark, sf_dir, "outage_messages"), table(spark, sf_dir, "origin_probes"))


def p1_state_at_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes with the interval in force at their target, whatever the version's status."""
    regions = asknown.version_regions(table(spark, sf_dir, "outage_messages"))
    rows = asknown.locate(table(spark, sf_dir, "origin_probes"), regions)
    return rows.selectExpr("probe_id", "message_id", "version", "status", "valid_from div 1000000 as valid_from_s", "valid_to div 1000000 as valid_to_s", "mw")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local spikes, which stay within what the source shows in sustained operation, are no cases."""
    return anomaly.implausible(table(spark, sf_dir, "kepler_samples")).filter("flag <> 'local'").select("sample_id")


def p3_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by source, with the least certain of them."""
    samples = table(spark, sf_dir, "kepler_samples")
    flags = anomaly.implausible(samples).join(samples.select("sample_id", "series_id"), "sample_id")
    return flags.groupBy("series_id", "flag").agg(F.count("*").alias("n"), F.min("probability").alias("least_probability"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.outage_periods(table(spark, sf_dir, "outage_messages"))


def p5_regular_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = regrid.capture_grid(table(spark, sf_dir, "kepler_samples"), table(spark, sf_dir, "scrape_targets"), table(spark, sf_dir, "capture_runs"))
    return grid.selectExpr("capture_id", "source_id", "cell_s", "readings", "round(covered_s, 4) as covered_s", "round(amount, 4) as amount", "round(value, 4) as value", "missing")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = regrid.capture_grid(table(spark, sf_dir, "kepler_samples"), table(spark, sf_dir, "scrape_targets"), table(spark, sf_dir, "capture_runs"))
    return grid.filter("missing").select("capture_id", "source_id", "cell_s")


QUERIES = {"p1_found": p1_found, "p1_state_at_origin": p1_state_at_origin, "p3_found": p3_found, "p3_flags": p3_flags, "p4_found": p4_found, "p5_found": p5_found, "p5_regular_grid": p5_regular_grid}

_LIVE = """
live as (
  select distinct upper(trim(identifier)) as identifier, message_id, version, upper(trim(event_status)) as status, unit_code,
    publication_date as pub, interval_start as vf, interval_end as vt, unavailable_capacity_mw as mw
  from outage_messages
  where identifier is not null and publication_date is not null and interval_start is not null and interval_end is not null
    and unavailable_capacity_mw is not null)
"""

_REGIONS = """
versions as (select distinct identifier, pub, version from live),
spans as (select *, lead(pub) over (partition by identifier order by pub, version) as superseded from versions),
hits as (
  select distinct p.probe_id, l.message_id, l.version, l.status, l.vf, l.vt, l.mw
  from origin_probes p join live l on l.identifier = upper(trim(p.identifier))
  join spans s on s.identifier = l.identifier and s.pub = l.pub and s.version = l.version
  where p.origin >= s.pub and (s.superseded is null or p.origin < s.superseded) and p.target_time >= l.vf and p.target_time < l.vt)
"""

ORACLE = {
    "p1_found": f"with {_LIVE}, {_REGIONS} select distinct probe_id, message_id from hits where status = 'ACTIVE'",
    "p1_state_at_origin": f"""with {_LIVE}, {_REGIONS} select probe_id, message_id, version, status, epoch_us(vf) // 1000000 as valid_from_s,
        epoch_us(vt) // 1000000 as valid_to_s, mw from hits""",
    "p4_found": f"""with {_LIVE},
final as (select identifier, max(struct_pack(pub := pub, version := version)) as v from live group by 1),
rows_in as (
  select l.unit_code, epoch_us(l.vf) as s, epoch_us(l.vt) as e from live l join final f on f.identifier = l.identifier and f.v.pub = l.pub and f.v.version = l.version
  where l.status = 'ACTIVE' and l.mw > 0 and not isnan(l.mw) and l.vt > l.vf and l.unit_code is not null),
flagged as (
  select *, case when s <= max(e) over (partition by unit_code order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from rows_in),
numbered as (select *, sum(fresh) over (partition by unit_code order by s, e rows unbounded preceding) as g from flagged),
periods as (select unit_code, min(s) as s, max(e) as e from numbered group by unit_code, g),
gaps as (select unit_code, e as s, lead(s) over (partition by unit_code order by s) as e from periods)
select unit_code, 'period' as kind, s // 1000000 as start_s, e // 1000000 as end_s from periods
union all select unit_code, 'gap', s // 1000000, e // 1000000 from gaps where e is not null""",
    "p5_found": r"""with
src as (
  select distinct capture_id, series_id as source_id, 1 as kind from kepler_samples where series_id is not null and capture_id is not null
  union all select distinct capture_id, target_id, 2 from scrape_targets where target_id is not null and capture_id is not null),
cells as (
  select s.capture_id, s.source_id, s.kind, w, unnest(range(epoch_us(c.started_at) // (w * 1000000) * w, (epoch_us(c.ended_at) - 1) // (w * 1000000) * w + 1, w)) as cell_s
  from (select *, case when kind = 1 then step_s else 60 end::bigint as w from src join capture_runs using (capture_id)) s join capture_runs c using (capture_id)),
seen as (
  select capture_id, series_id as source_id, 1 as kind, epoch_us(sample_ts) as us from kepler_samples
  where regexp_full_match(trim(sample_value), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') and isfinite(try_cast(trim(sample_value) as double))
  union all
  select capture_id, target_id, 2, epoch_us(try_cast(regexp_replace(last_scrape, '(\.[0-9]{1,6})[0-9]*', '\1') as timestamptz)) from scrape_targets
  where lower(trim(health)) = 'up' and try_cast(regexp_replace(last_scrape, '(\.[0-9]{1,6})[0-9]*', '\1') as timestamptz) > timestamptz '1900-01-01 00:00:00+00'),
filled as (
  select distinct s.capture_id, s.source_id, s.kind, s.us // (w * 1000000) * w as cell_s
  from seen s join (select capture_id, step_s, unnest([1, 2]) as kind from capture_runs) c on c.capture_id = s.capture_id and c.kind = s.kind, lateral (select case when s.kind = 1 then step_s else 60 end::bigint as w) x)
select capture_id, source_id, cell_s from cells anti join filled using (capture_id, source_id, kind, cell_s)""",
    "p5_regular_grid": r"""with
src as (
  select capture_id, series_id as source_id, 1 as kind, bool_or(metric_name like '%\_total' escape '\') as counter from kepler_samples where series_id is not null and capture_id is not null group by 1, 2
  union all select distinct capture_id, target_id, 2, false from scrape_targets where target_id is not null and capture_id is not null),
wide as (select src.*, case when kind = 1 then step_s else 60 end::bigint as w, epoch_us(started_at) as f, epoch_us(ended_at) as t from src join capture_runs using (capture_id)),
cells as (select *, unnest(range(f // (w * 1000000) * w, (t - 1) // (w * 1000000) * w + 1, w)) as cell_s from wide),
seen as (
  select capture_id, series_id as source_id, 1 as kind, epoch_us(sample_ts) as us, try_cast(trim(sample_value) as double) as v from kepler_samples
  where regexp_full_match(trim(sample_value), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') and isfinite(try_cast(trim(sample_value) as double))
  union all
  select capture_id, target_id, 2, epoch_us(try_cast(regexp_replace(last_scrape, '(\.[0-9]{1,6})[0-9]*', '\1') as timestamptz)), coalesce(last_scrape_duration_s, 0.0) from scrape_targets
  where lower(trim(health)) = 'up' and try_cast(regexp_replace(last_scrape, '(\.[0-9]{1,6})[0-9]*', '\1') as timestamptz) > timestamptz '1900-01-01 00:00:00+00'),
one as (select capture_id, source_id, kind, us, max(v) as v from seen where us is not null group by 1, 2, 3, 4),
pairs as (select one.*, w, counter, lag(us) over q as pt, lag(one.v) over q as pv from one join wide using (capture_id, source_id, kind) window q as (partition by capture_id, source_id, kind order by us)),
stretches as (select *, coalesce(us - pt <= 900000000, false) as joined from pairs),
pieces as (select *, unnest(range(case when joined then pt else us end // (w * 1000000) * w, us // (w * 1000000) * w + 1, w)) as cell_s from stretches),
cut as (select *, greatest(pt, cell_s * 1000000) as a, least(us, (cell_s + w) * 1000000) as b, us // (w * 1000000) * w = cell_s as here from pieces),
shares as (
  select capture_id, source_id, kind, cell_s, here, v, case when joined then (b - a) / 1e6 end as span,
    case when joined and counter then (case when v >= pv then v - pv else greatest(v, 0.0) end) * (b - a) / (us - pt)
      when joined then ((pv + (v - pv) * ((a - pt) / (us - pt))) + (pv + (v - pv) * ((b - pt) / (us - pt)))) / 2 * (b - a) / 1e6 end as amount
  from cut),
grid as (select capture_id, source_id, kind, cell_s, sum(here::int) as readings, coalesce(sum(span), 0.0) as covered, sum(amount) as amount, avg(case when here then v end) as mean from shares group by 1, 2, 3, 4)
select c.capture_id, c.source_id, c.cell_s, coalesce(readings, 0)::bigint as readings, round(coalesce(covered, 0.0), 4) as covered_s, case when counter then round(amount, 4) end as amount,
  case when not counter then round(case when covered > 0 then amount / covered else mean end, 4) end as value, coalesce(readings, 0) = 0 as missing
from cells c left join grid g on g.capture_id = c.capture_id and g.source_id = c.source_id and g.kind = c.kind and g.cell_s = c.cell_s""",
}

"""Oracles of the parameter search: every set evaluated the long way."""

from oracles.common import ROLLUP, bucket_ctes, upto
from oracles.detection import cents


def u(i: int, key: str = "o_orderkey") -> str:
    return f"(({key} * {7919 + 2 * i} + {104729 * (i + 1)}) % 10007 / 10007.0::DOUBLE)"


def stepped(i: int, low: float, high: float, step: float, kind: str = "DOUBLE") -> str:
    n = round((high - low) / step) + 1
    value = f"{low}::DOUBLE + floor({u(i)} * {n}) * {step}::DOUBLE"
    return f"CAST({value} AS INTEGER)" if kind == "INTEGER" else f"round_even(({value}) * 1e9::DOUBLE, 0) / 1e9::DOUBLE"


def smooth(i: int, low: float, high: float) -> str:
    return f"round_even(({low}::DOUBLE + {u(i)} * ({high}::DOUBLE - {low}::DOUBLE)) * 1e9::DOUBLE, 0) / 1e9::DOUBLE"


def pick(*values) -> str:
    items = ", ".join(f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in values)
    return f"[{items}][n_nationkey % {len(values)} + 1]"


SETS = f"""
sets AS (
  SELECT CAST(n_nationkey AS BIGINT) AS param_id, {pick(0.35, 0.25)} AS tolerance, {pick(45, 50, 60)} AS seconds_gap,
         {pick(2, 3, 4, 5, 9)} AS min_unique, {pick(2, 3, 4)} AS min_segment,
         {pick(0, 3, 4, 5)} AS core_threshold, 0.02::DOUBLE + n_nationkey / 100.0::DOUBLE AS start,
         CAST(50 + n_nationkey AS DOUBLE) AS stop, CAST(20 + n_nationkey AS INTEGER) AS num, {pick(0.25, 0.5)} AS step,
         1.0::DOUBLE + n_nationkey / 50.0::DOUBLE AS growth, {pick(3.0, 5.0, 9.0)} AS int_threshold,
         {pick(0.1, 0.25, 0.5)} AS first_center FROM nation)"""


def evaluated(sets: str, p: str = "") -> str:
    """The error of each row of `sets` as `{p}trials`; sets without a detection on some date are left out."""
    return f"""
{bucket_ctes(sets, p)},
{p}kinds AS (SELECT DISTINCT tolerance, seconds_gap FROM {sets}),
{p}pairs AS (
  SELECT k.tolerance, k.seconds_gap, i.run_date, i.trigger_min, i.side, i.sec, i.stock, i.quantity,
         count(DISTINCT j.stock) AS n
  FROM blocks i JOIN blocks j
    ON i.run_date = j.run_date AND i.trigger_min = j.trigger_min AND i.side = j.side
  JOIN {p}kinds k ON j.ts_ns BETWEEN i.block_start_ns AND i.block_start_ns + CAST(k.seconds_gap AS BIGINT) * 1000000000
     AND j.num_lot >= i.num_lot * (1.0::DOUBLE - k.tolerance)
     AND j.num_lot <= i.num_lot * (1.0::DOUBLE + k.tolerance)
  GROUP BY ALL),
{p}like_rows AS (
  SELECT s.*, x.n, b.* FROM {p}pairs x JOIN blocks b USING (run_date, trigger_min, side, sec, stock, quantity)
  JOIN {sets} s ON s.tolerance = x.tolerance AND s.seconds_gap = x.seconds_gap AND x.n >= s.min_unique),
{p}spots AS (
  SELECT r.*, k.bucket_idx FROM {p}like_rows r JOIN {p}buckets k
    ON k.param_id = r.param_id AND r.num_lot BETWEEN k.lo AND k.hi),
{p}flags AS (
  SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY param_id, run_date, trigger_min, side, bucket_idx
    ORDER BY time_str, stock, ts_ns, quantity) >= 16000000000 THEN 1 ELSE 0 END AS gap FROM {p}spots),
{p}numbered AS (
  SELECT *, sum(gap) OVER (PARTITION BY param_id, run_date, trigger_min, side, bucket_idx
    ORDER BY time_str, stock, ts_ns, quantity ROWS UNBOUNDED PRECEDING) AS seg FROM {p}flags),
{p}strong AS (
  SELECT * FROM {p}numbered
  WINDOW w AS (PARTITION BY param_id, run_date, trigger_min, side, bucket_idx, seg)
  QUALIFY count(*) OVER w >= min_segment AND (core_threshold <= 0 OR max(n) OVER w >= core_threshold)),
{p}once AS (
  SELECT * FROM {p}strong QUALIFY row_number() OVER (PARTITION BY param_id, run_date, time_str, stock, ts_ns
    ORDER BY trigger_min, side DESC, bucket_idx, quantity) = 1),
{p}flows AS (
  SELECT param_id, run_date, sum(side * matched_value) AS net_flow FROM {p}once GROUP BY ALL),
{p}trials AS (
  SELECT param_id, round_even(avg(abs(net_flow - flow)) * 100, 0) / 100 AS mae
  FROM {p}flows LEFT JOIN truth USING (run_date) GROUP BY param_id
  HAVING count(*) = (SELECT count(DISTINCT run_date) FROM basket WHERE run_date <= DATE '2024-01-03'))"""


TRUTH = """
truth AS (
  SELECT run_date, sum(price * volume) AS flow FROM trades
  WHERE run_date <= DATE '2024-01-02' GROUP BY run_date)"""

TRIALS = f"{SETS},{TRUTH},{evaluated('sets')}"

# ---- the guided search

BINS, CANDIDATES, STARTUP, BATCH = 5, 24, 6, 4
DETECTION = {
    "seconds_early": (5, 25, 1),
    "tolerance": (0.12, 0.35, 0),
    "seconds_gap": (45, 60, 1),
    "min_unique": (2, 5, 1),
    "min_segment": (2, 4, 1),
    "core_threshold": (0, 4, 1),
}
SHAPE = {
    "start": (0.02, 0.8, 0),
    "stop": (50, 100, 1),
    "num": (20, 60, 1),
    "step": (0.25, 0.5, 0.05),
    "growth": (1.0, 1.5, 0),
    "int_threshold": (3, 9, 1),
    "first_center": (0.05, 0.5, 0.05),
}
FIXED_SHAPE = {"start": 0.15, "stop": 89.0, "num": 25, "step": 0.25, "growth": 1.13, "int_threshold": 4.0, "first_center": 0.2}
WHOLE = {"seconds_early", "seconds_gap", "min_unique", "min_segment", "core_threshold", "num"}


def of_kind(name: str, value: str) -> str:
    return f"CAST({value} AS INTEGER)" if name in WHOLE else f"round_even(({value}) * 1e9::DOUBLE, 0) / 1e9::DOUBLE"


def even(name: str, i: int, low: float, high: float, step: float) -> str:
    """A value drawn evenly."""
    if not step:
        return of_kind(name, f"{low}::DOUBLE + {u(i, 'param_id')} * ({high}::DOUBLE - {low}::DOUBLE)")
    n = round((high - low) / step) + 1
    return of_kind(name, f"{low}::DOUBLE + floor({u(i, 'param_id')} * {n}) * {step}::DOUBLE")


def beside(name: str, i: int, low: float, high: float, step: float) -> str:
    """A value near that of a good trial."""
    x = f"near_{name} + ({u(i, 'param_id')} - 0.5::DOUBLE) * (2.0::DOUBLE * ({high}::DOUBLE - {low}::DOUBLE) / {BINS}::DOUBLE)"
    x = f"least(greatest({x}, {low}::DOUBLE), {high}::DOUBLE)"
    if step:
        x = f"{low}::DOUBLE + round_even((({x}) - {low}::DOUBLE) / {step}::DOUBLE, 0) * {step}::DOUBLE"
    return of_kind(name, x)


def cells(ranges: dict) -> str:
    """Name and bin of each value, as a list to unnest."""
    return ", ".join(
        f"{{name: '{n}', bin: CAST(least(greatest(floor(({n} - {lo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE) * {BINS}.0::DOUBLE), 0), {BINS - 1}) AS INTEGER)}}"
        for n, (lo, hi, _) in ranges.items()
    )


def guided_stage(p: str, ranges: dict, fixed: str, source: str) -> str:
    """Two batches of a stage: `{p}first` drawn evenly, `{p}next` learned from its errors; `{p}log` holds both. `fixed` gives
    the other stage's values, from `source`."""
    names = ", ".join(ranges)
    drawn = ", ".join(f"{even(n, i, *r)} AS {n}" for i, (n, r) in enumerate(ranges.items()))
    near = ", ".join(f"coalesce({beside(n, i, *r)}, {even(n, i, *r)}) AS {n}" for i, (n, r) in enumerate(ranges.items()))
    place = u(len(ranges), "param_id")
    return f"""
{p}first AS (SELECT param_id, {drawn}, {fixed} FROM range(0, {STARTUP}) g(param_id){source}),
{evaluated(f"{p}first", f"{p}a_")},
{p}seen AS (
  SELECT s.*, mae, row_number() OVER (ORDER BY mae NULLS LAST, s.param_id) AS place FROM {p}first s LEFT JOIN {p}a_trials USING (param_id)),
{p}ranked AS (SELECT *, mae IS NOT NULL AND place <= greatest(ceil({STARTUP} * 0.25), 1) AS good FROM {p}seen),
{p}goods AS (SELECT count(*) FILTER (good) AS goods, count(*) FILTER (NOT good) AS bads FROM {p}ranked),
{p}counts AS (
  SELECT cell.name AS name, cell.bin AS bin, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b
  FROM (SELECT good, unnest([{cells(ranges)}]) AS cell FROM {p}ranked) GROUP BY ALL),
{p}gains AS (
  SELECT name, bin, ln((coalesce(g, 0) + 1) / (goods + {BINS})::DOUBLE) - ln((coalesce(b, 0) + 1) / (bads + {BINS})::DOUBLE) AS gain
  FROM (SELECT * FROM {p}goods, (SELECT unnest([{", ".join(f"'{n}'" for n in ranges)}]) AS name), range(0, {BINS}) g(bin))
  LEFT JOIN {p}counts USING (name, bin)),
{p}ids AS (
  SELECT param_id, CASE WHEN param_id % 2 = 1 AND goods > 0 THEN floor({place} * goods) + 1 END AS pick
  FROM range({STARTUP * CANDIDATES}, {(STARTUP + BATCH) * CANDIDATES}) g(param_id), {p}goods),
{p}drawn AS (
  SELECT param_id, {near}
  FROM {p}ids LEFT JOIN (SELECT place AS pick, {", ".join(f"{n} AS near_{n}" for n in ranges)} FROM {p}ranked WHERE good) USING (pick)),
{p}scores AS (
  SELECT param_id, round_even(sum(gain) * 1e9::DOUBLE, 0) / 1e9::DOUBLE AS score
  FROM (SELECT param_id, unnest([{cells(ranges)}]) AS cell FROM {p}drawn) c JOIN {p}gains ON name = cell.name AND bin = cell.bin GROUP BY param_id),
{p}best AS (SELECT *, row_number() OVER (ORDER BY score DESC, param_id) AS rn FROM {p}drawn JOIN {p}scores USING (param_id)),
{p}next AS (SELECT {STARTUP - 1} + rn AS param_id, {names}, {fixed} FROM {p}best{source} WHERE rn <= {BATCH}),
{evaluated(f"{p}next", f"{p}b_")},
{p}log AS (
  SELECT param_id, {names}, mae FROM {p}seen
  UNION ALL SELECT param_id, {names}, mae FROM {p}next LEFT JOIN {p}b_trials USING (param_id)),
{p}winner AS (SELECT * FROM {p}log WHERE mae IS NOT NULL ORDER BY mae, param_id LIMIT 1)"""


ONE = guided_stage("one_", DETECTION, ", ".join(f"{v}{'' if isinstance(v, int) else '::DOUBLE'} AS {n}" for n, v in FIXED_SHAPE.items()), "")
FROZEN = ", (SELECT " + ", ".join(f"{n} AS frozen_{n}" for n in DETECTION) + " FROM one_winner)"
TWO = guided_stage("two_", SHAPE, ", ".join(f"frozen_{n} AS {n}" for n in DETECTION), FROZEN)
SEARCH = f"""{TRUTH},{ONE},{TWO}
SELECT 'stage1' AS stage, param_id, seconds_early, tolerance, seconds_gap, min_unique, min_segment, core_threshold,
       {", ".join(f"NULL AS {n}" for n in SHAPE)}, mae FROM one_log
UNION ALL
SELECT 'stage2', param_id, {", ".join("NULL" for _ in DETECTION)}, {", ".join(SHAPE)}, mae FROM two_log"""

ORACLES = {
    "two_stage_search": upto(ROLLUP, "").rstrip() + f", {SEARCH}",
    "param_grid": f"""SELECT o_orderkey AS param_id, {stepped(0, 5, 25, 1, 'INTEGER')} AS seconds_early,
        {smooth(1, 0.12, 0.35)} AS tolerance, {stepped(2, 45, 60, 1, 'INTEGER')} AS seconds_gap,
        {stepped(3, 7, 24, 1, 'INTEGER')} AS min_unique, {stepped(4, 6, 25, 1, 'INTEGER')} AS min_segment,
        {stepped(5, 8, 20, 1, 'INTEGER')} AS core_threshold, {smooth(6, 0.02, 0.8)} AS start,
        {stepped(7, 50, 100, 1)} AS stop, {stepped(8, 20, 60, 1, 'INTEGER')} AS num,
        {stepped(9, 0.25, 0.5, 0.05)} AS step, {smooth(10, 1.0, 1.5)} AS growth,
        {stepped(11, 3, 9, 1)} AS int_threshold, {stepped(12, 0.05, 0.5, 0.05)} AS first_center
        FROM orders""",
    "param_sweep": upto(ROLLUP, "").rstrip() + f", {TRIALS} SELECT param_id, mae FROM trials",
    "sweep_top10": upto(ROLLUP, "").rstrip()
    + f""", {TRIALS} SELECT param_id, tolerance, seconds_gap, min_unique, min_segment, mae
        FROM trials JOIN sets USING (param_id) ORDER BY mae NULLS LAST, param_id LIMIT 10""",
    "best_per_stage": upto(ROLLUP, "").rstrip()
    + f""", {TRIALS} SELECT CASE WHEN param_id < 12 THEN 'stage1' ELSE 'stage2' END AS stage, param_id, mae
        FROM trials WHERE mae IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY param_id < 12 ORDER BY mae, param_id) = 1""",
}

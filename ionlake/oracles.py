"""DuckDB SQL for the registered queries, over lists and range joins where the queries use windows.

Filter weights are inlined from the same function on both sides, so that both see the same doubles.
"""

from __future__ import annotations

from .functions import kernels, weights

EVENTS = """select user_id as spectrum_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as i,
  (count(*) over (partition by user_id))::int as n, 100 + (epoch_us(ts) - 1704067200000000) / 1e9::double as mz, value as intensity from events"""
LINES = """select l_partkey as spectrum_id, (row_number() over (partition by l_partkey order by l_extendedprice, l_orderkey, l_linenumber) - 1)::int as i,
  (count(*) over (partition by l_partkey))::int as n, 100 + l_extendedprice::double / 100 as mz, l_quantity::double as intensity from lineitem"""
EMBEDDINGS = """select vec_id as spectrum_id, unnest(range(len(embedding)))::int as i, len(embedding)::int as n,
  100 + 0.5::double * unnest(range(len(embedding))) as mz, abs(unnest(embedding)::double) as intensity from embeddings"""
PIXELS = "select vec_id as spectrum_id, (vec_id % 25 + 1)::int as x, (vec_id // 25 + 1)::int as y, 1 as z, list_transform(embedding, lambda e: abs(e::double)) as xs, label as region from embeddings"


def nested(source: str, *steps: str) -> str:
    """CTEs p (points) and g (a row a spectrum: xs, ms, n), then further steps ``name as (...)``."""
    first = f"with p as ({source}), g as (select spectrum_id, list(intensity order by i) as xs, list(mz order by i) as ms, count(*)::int as n from p group by spectrum_id)"
    return ", ".join([first, *steps])


def each(body: str) -> str:
    return f"list_transform(range(n), lambda i: {body})"


def step(name: str, base: str, column: str, value: str) -> str:
    return f"{name} as (select *, {value} as {column} from {base})"


def curve(table: str, lists: str, name: str = "intensity", digits: int = 6) -> str:
    return f" select spectrum_id, unnest(range(n))::int as i, round(unnest({lists}), {digits}) + 0.0 as {name} from {table}"


def convolved(xs: str, kernel: list[float]) -> str:
    r = len(kernel) // 2
    return each(" + ".join(f"{w!r}::double * {xs}[greatest(1, least(n, i + 1 + ({k - r})))]" for k, w in enumerate(kernel)))


def is_peak(xs: str, r: int, right_edge: int) -> str:
    after = f"coalesce(list_max({xs}[i + 2 : i + 1 + {r}]), '-inf'::double)"
    return f"(i >= {r} and i <= n - 1 - {right_edge} and coalesce(list_max({xs}[i + 1 - {r} : i]), '-inf'::double) < {xs}[i + 1] and {after} <= {xs}[i + 1])"


def locmin(xs: str, base: str, name: str, r: int, upper: bool = False) -> list[str]:
    turned = xs if upper else f"list_transform({xs}, lambda v: -v)"
    line = f"""case when prv[i + 1] = nxt[i + 1] then {xs}[i + 1] else {xs}[prv[i + 1] + 1] + ({xs}[nxt[i + 1] + 1] - {xs}[prv[i + 1] + 1]) * (i - prv[i + 1]) / (nxt[i + 1] - prv[i + 1]) end"""
    flat = f"list_{'max' if upper else 'min'}({xs})"
    return [
        step(f"{name}_t", base, "turned", turned),
        step(f"{name}_a", f"{name}_t", "anchors", f"list_filter(range(n), lambda i: i = 0 or i = n - 1 or {is_peak('turned', r, r)})"),
        step(f"{name}_n", f"{name}_a", "prv", each("list_max(list_filter(anchors, lambda a: a <= i))")),
        step(f"{name}_p", f"{name}_n", "nxt", each("list_min(list_filter(anchors, lambda a: a >= i))")),
        step(name, f"{name}_p", "baseline", f"case when n < 3 then {each(flat)} else {each(line)} end"),
    ]


RESIDUAL = step("r0", "g", "smoothed", convolved("xs", weights.gaussian(9, 2.0)))
NOISE = {
    "sd": "list_aggregate(r, 'stddev_samp')",
    "mad": "1.4826::double * list_aggregate(list_transform(r, lambda v: abs(v - mid)), 'median')",
    "quantile": "list_aggregate(r, 'quantile_cont', 0.95)",
    "diff": "list_aggregate(list_transform(xs, lambda v: abs(v - (xs[n] - xs[1]) / (n - 1))), 'avg')",
}


def noisy(method: str, base: str = "g", xs: str = "xs") -> list[str]:
    """Steps to a table ``s`` with a column noise."""
    return [
        step("s0", base, "smooth9", convolved(xs, weights.gaussian(9, 2.0))),
        step("s1", "s0", "r", each(f"abs(smooth9[i + 1] - {xs}[i + 1])")),
        step("s2", "s1", "mid", "list_aggregate(r, 'median')"),
        step("s", "s2", "noise", f"greatest(coalesce({NOISE[method].replace('xs', xs)}, 0.001), 0.001)"),
    ]


def picked(table: str, xs: str, r: int, more: str) -> str:
    return f""" select spectrum_id, pk.i::int as i, round(ms[pk.i + 1], 6) as mz, round({xs}[pk.i + 1], 6) as intensity from
  (select *, unnest(list_transform(list_filter(range(n), lambda i: {is_peak(xs, r, r - 1)}), lambda i: {{'i': i}})) as pk from {table}) where {more}"""


def normalized(base: str, factor: str = "n") -> str:
    return nested(EVENTS, step("b", "g", "base", base)) + curve("b", each(f"case when base > 0 then xs[i + 1] * {factor} / base else 0 end"))


def savgol(window: int, order: int) -> str:
    rows = weights.savgol(window, order)
    half = window // 2
    body = "case when n < 7 then xs[i + 1]"
    for p, row in enumerate(rows):
        when = f"i = {p}" if p < half else f"i = n - {window - p}" if p > half else "true"
        if p == half:
            continue
        body += f" when {when} then " + " + ".join(f"{k!r}::double * xs[i + 1 + ({j - p})]" for j, k in enumerate(row))
    body += " else " + " + ".join(f"{k!r}::double * xs[i + 1 + ({j - half})]" for j, k in enumerate(rows[half])) + " end"
    return nested(EMBEDDINGS) + curve("g", each(body))


def snip(m: int) -> str:
    steps, base = [], "g"
    for k, p in enumerate(range(m, 0, -1)):
        y = "xs" if k == 0 else f"y{k}"
        steps.append(step(f"k{k + 1}", base, f"y{k + 1}", each(f"least({y}[i + 1], case when i >= {p} and i < n - {p} then ({y}[i + 1 - {p}] + {y}[i + 1 + {p}]) / 2 else {y}[i + 1] end)")))
        base = f"k{k + 1}"
    return nested(LINES, *steps) + curve(base, f"y{m}", "baseline")


def binned(bounds: str, value: str) -> str:
    return (
        nested(EVENTS, RESIDUAL, step("r1", "r0", "r", each("abs(smoothed[i + 1] - xs[i + 1])")), f"bins as (select *, unnest(range(4)) as b from r1)", f"cut as (select *, {bounds} from bins)")
        + f" select spectrum_id, b::int as b, (low + high) / 2 as mid, round(greatest(coalesce({value}, 0.001), 0.001), 6) as noise from cut"
    )


RESOLUTION = f"""with p as ({LINES}), d as (select *, 2 * (mz - lag(mz) over (partition by spectrum_id order by mz)) / (mz + lag(mz) over (partition by spectrum_id order by mz)) as gap from p),
  res as (select spectrum_id, min(gap) filter (gap > 2.220446049250313e-16) as resolution, min(mz) as low, max(mz) as high from d group by spectrum_id)"""
DOMAIN = RESOLUTION + """, raw as (select floor(min(low)) as low, ceil(max(high)) as high, greatest(5e-7, round(2 * median(resolution), 6) * 0.5) as step from res),
  dom as (select low, high, step, round(2 * (step * 2), 6) * 0.5 as tolerance, (1 + step / 2) / (1 - step / 2) as rho from raw)"""
BINS = DOMAIN + """, grid as (select k, low * pow(rho, k) as v from dom, range(0, (select floor(1 + (ln(high) - ln(low)) / ln(rho))::bigint from dom)) t(k)),
  below as (select p.spectrum_id, p.i, p.mz, grid.k, grid.v from p asof join grid on p.mz >= grid.v),
  near as (select b.spectrum_id, b.i, b.mz, case when u.v is not null and abs(b.mz - u.v) < abs(b.mz - b.v) then u.k else b.k end as bin,
    case when u.v is not null and abs(b.mz - u.v) < abs(b.mz - b.v) then abs(b.mz - u.v) else abs(b.mz - b.v) end / abs(b.mz) as off
    from below b left join grid u on u.k = b.k + 1),
  best as (select spectrum_id, bin, arg_min(mz, {'off': off, 'i': i}) as mz from near, dom where off <= tolerance group by spectrum_id, bin),
  bins as (select bin, avg(mz) as mz, count(*) as cnt from best group by bin)"""
MERGE = BINS + """, numbered as (select row_number() over (order by bin) as pos, mz, cnt from bins),
  scan as (with recursive w as (
      select pos, mz, cnt, 0 as seg, false as falling from numbered where pos = 1
      union all
      select x.pos, x.mz, x.cnt,
        w.seg + case when (x.mz - w.mz) / abs(x.mz) > dom.tolerance or (x.cnt > w.cnt and w.falling) then 1 else 0 end,
        case when (x.mz - w.mz) / abs(x.mz) > dom.tolerance or (x.cnt > w.cnt and w.falling) then false else w.falling or x.cnt < w.cnt end
      from w join numbered x on x.pos = w.pos + 1, dom)
    select * from w),
  merged as (select seg, sum(cnt * mz) / sum(cnt) as mz, sum(cnt)::bigint as cnt from scan group by seg)"""

#: Spectra on the reference axis: the references each peak can reach, the upward walk from peak to peak, the nearest peaks.
ON_AXIS = MERGE + """, g as (select spectrum_id, list(mz order by i) as ms, list(intensity order by i) as xs, count(*)::int as n from p group by spectrum_id),
  refs as (select seg as r, mz as ref from merged), nr as (select count(*) as n_ref from merged),
  cand as (select p.spectrum_id, p.i, p.mz, refs.r, refs.ref from p, refs, dom where refs.ref between p.mz * (1 - 1.2 * dom.tolerance) and p.mz * (1 + 1.2 * dom.tolerance)),
  reach as (select spectrum_id, i, min(r) as lo, max(r) as hi, arg_min(r, {'off': abs(ref - mz), 'r': r}) as home from cand, dom where abs(ref - mz) <= mz * dom.tolerance group by spectrum_id, i),
  line as (select *, row_number() over (partition by spectrum_id order by i) as pos from reach),
  walk as (with recursive w as (
      select spectrum_id, pos, lo as a, hi as b, hi as e from line where pos = 1
      union all
      select l.spectrum_id, l.pos, case when l.home > w.e then greatest(l.lo, w.e + 1) end, case when l.home > w.e then l.hi end, case when l.home > w.e then l.hi else w.e end
      from w join line l on l.spectrum_id = w.spectrum_id and l.pos = w.pos + 1)
    select * from w),
  up as (select distinct w.spectrum_id, unnest(range(w.a, w.b + 1)) as r from walk w join g using (spectrum_id), nr where w.a is not null and GOES_UP),
  down as (select distinct c.spectrum_id, c.r from cand c join g using (spectrum_id), nr, dom where not GOES_UP and abs(c.mz - c.ref) / abs(c.ref) <= dom.tolerance),
  hit as (select spectrum_id, r from up union all select spectrum_id, r from down),
  spot as (select h.spectrum_id, h.r, refs.ref, g.ms, g.xs, least(len(list_filter(g.ms, lambda m: m < refs.ref)), g.n - 1) as k from hit h join g using (spectrum_id) join refs on refs.r = h.r),
  found as (select spectrum_id, r, ref, case when abs(ms[k + 1] - ref) < abs(ref - ms[greatest(k, 1)]) then xs[k + 1] else xs[greatest(k, 1)] end as intensity from spot)"""
AUTO = ON_AXIS.replace("GOES_UP", "nr.n_ref > 2 * g.n")
UP = ON_AXIS.replace("GOES_UP", "true").replace(LINES, EVENTS)


def neighbour_smoothed(k: int, bilateral: bool) -> str:
    """Means over the k nearest points by m/z, weighted by their distance and, bilateral, by the difference in height."""
    at = "starts[i + 1] + 1 + j"
    weight = f"exp(greatest(-0.5 * pow((ms[{at}] - ms[i + 1]) / sd, 2), -88))"
    if bilateral:
        weight += f" * case when wide > 0 then exp(greatest(-0.5 * pow((xs[{at}] - xs[i + 1]) / wide, 2), -88)) else 1 end"
    return nested(
        EVENTS,
        step("n0", "g", "k", f"least({k}, n)"),
        step("n1", "n0", "starts", each("len(list_filter(range(n - k), lambda s: ms[i + 1] - ms[s + 1] > ms[s + k + 1] - ms[i + 1]))")),
        step("n2", "n1", "far", each("greatest(ms[i + 1] - ms[starts[i + 1] + 1], ms[starts[i + 1] + k] - ms[i + 1])")),
        step("n3", "n2", "sd", "list_aggregate(far, 'median') / 2"),
        step("n4", "n3", "mid", "list_aggregate(xs, 'median')"),
        step("n5", "n4", "wide", "1.4826::double * list_aggregate(list_transform(xs, lambda v: abs(v - mid)), 'median')"),
        step("n6", "n5", "value", each(f"list_sum(list_transform(range(k), lambda j: {weight} * xs[{at}])) / list_sum(list_transform(range(k), lambda j: {weight}))")),
    ) + curve("n6", "value", "value")


#: A noise curve: estimates in four half-overlapping bins, and the cubic through them.
NOISE_CURVE = [
    step("c0", "s1", "w", "n / 2.5::double"),
    step("c1", "c0", "lows", "list_transform(range(4), lambda b: greatest(0, floor(b * w * 0.5))::int)"),
    step("c2", "c1", "highs", "list_transform(range(4), lambda b: (least(n - 1, ceil(b * w * 0.5 + w) - 1))::int)"),
    step("c3", "c2", "mids", "list_transform(range(4), lambda b: (lows[b + 1] + highs[b + 1]) / 2)"),
    step("c4", "c3", "vals", "list_transform(range(4), lambda b: coalesce(list_aggregate(r[lows[b + 1] + 1 : highs[b + 1] + 1], 'stddev_samp'), 0))"),
    step("c5", "c4", "along", each("greatest(0.001, " + " + ".join(f"vals[{j}]" + "".join(f" * (i - mids[{m}]) / (mids[{j}] - mids[{m}])" for m in range(1, 5) if m != j) for j in range(1, 5)) + ")")),
]
PROMINENT = [
    f"k as (select *, unnest(list_filter(range(n), lambda i: {is_peak('xs', 2, 1)})) as pk from s)",
    "e as (select *, coalesce(list_max(list_filter(range(pk), lambda j: xs[j + 1] > xs[pk + 1])), -1) as a, coalesce(list_min(list_filter(range(pk + 1, n), lambda j: xs[j + 1] > xs[pk + 1])), n) as b from k)",
    "f as (select *, xs[pk + 1] - greatest(list_min(xs[a + 2 : pk + 1]), list_min(xs[pk + 1 : b])) as prominence from e)",
]


def foot(name: str, base: str, xs: str, pk: str, column: str) -> list[str]:
    """Where a peak ends to the right: the first new low after which the next other sample is higher, and not a sample's
    spike; else the last new low."""
    other = f"list_min(list_filter(range(q + 1, n), lambda j: {xs}[j + 1] <> {xs}[q + 1]))"
    spike = f"({other} = q + 1 and q + 2 < n and {xs}[q + 3] < {xs}[q + 1])"
    return [
        step(f"{name}0", base, f"{name}_lows", f"list_filter(range({pk} + 1, n), lambda q: {xs}[q + 1] < list_min({xs}[{pk} + 1 : q]))"),
        step(f"{name}1", f"{name}0", f"{name}_ends", f"list_filter({name}_lows, lambda q: coalesce({xs}[{other} + 1] > {xs}[q + 1] and not {spike}, false))"),
        step(name, f"{name}1", column, f"coalesce({name}_ends[1], {name}_lows[len({name}_lows)], {pk})"),
    ]


SMOOTH5 = convolved("flat", weights.gaussian(5))

ORACLES: dict[str, str] = {
    "points_events": f"select spectrum_id, i, n, round(mz, 6) as mz, round(intensity, 6) as intensity from ({EVENTS})",
    "points_embeddings": f"select spectrum_id, i, n, round(mz, 6) as mz, round(intensity, 6) as intensity from ({EMBEDDINGS})",
    "points_lineitem": f"select spectrum_id, i, n, round(mz, 6) as mz, round(intensity, 6) as intensity from ({LINES})",
    "matrix_scan": nested(EVENTS, "w as (select max(n) as wide from g)", "c as (select g.*, unnest(range(wide)) as i from g, w)")
    + " select spectrum_id, i::int as i, round(coalesce(ms[i + 1], 0), 6) as mz, round(coalesce(xs[i + 1], 0), 6) as intensity from c",
    "crop_mz": f"select spectrum_id, (row_number() over (partition by spectrum_id order by i) - 1)::int as i, (count(*) over (partition by spectrum_id))::int as n, round(mz, 6) as mz, round(intensity, 6) as intensity from ({EVENTS}) where mz between 500 and 1500",
    "is_sorted": nested(EVENTS) + " select spectrum_id, ms = list_sort(ms) as is_sorted from g",
    "spatial_window": f"select spectrum_id, x, y, z from ({PIXELS}) where x between 3 and 12 and y between 2 and 6",
    "pixel_upsert": """with last as (select min(vec_id) as spectrum_id, (vec_id % 5)::int as x, (vec_id % 7)::int as y, 1 as z, arg_max(label, vec_id) as region,
      arg_max(embedding, vec_id) as e from embeddings group by vec_id % 5, vec_id % 7)
      select spectrum_id, x, y, z, region, unnest(range(len(e)))::int as i, round(abs(unnest(e)::double), 6) as intensity from last""",
    "rows_slice": f"select spectrum_id, x, y from ({PIXELS}) where spectrum_id between 10 and 199 and (spectrum_id - 10) % 3 = 0",
    "clamp_negative": f"select spectrum_id, i, round(greatest(intensity - 20, 0), 6) as intensity from ({EVENTS})",
    "spectrum_stats": nested(EVENTS) + " select spectrum_id, n::bigint as n, round(list_min(ms), 6) as mz_min, round(list_max(ms), 6) as mz_max, round(ms[list_position(xs, list_max(xs))], 6) as base_mz, round(list_max(xs), 6) as base_intensity, round(list_sum(xs), 4) as tic from g",
    "norm_tic": normalized("list_sum(xs)"),
    "norm_rms": normalized("sqrt(list_avg(list_transform(xs, lambda v: v * v)))"),
    "norm_ref": normalized("xs[list_position(ms, list_filter(ms, lambda m: abs(m - 1000) <= 20 and abs(m - 1000) = list_min(list_transform(ms, lambda o: abs(o - 1000))))[1])]", "1.0"),
    "norm_median": normalized("list_aggregate(xs, 'median')"),
    "smooth_ma": nested(EVENTS) + curve("g", each(" + ".join(f"xs[greatest(1, least(n, i + 1 + ({k})))]" for k in range(-2, 3))).replace("lambda i: ", "lambda i: (", 1)[:-1] + ") / 5)"),
    "smooth_ma_coef": nested(EVENTS) + curve("g", convolved("xs", [4 / 7, 2 / 7, 1 / 7])),
    "smooth_gaussian": nested(EVENTS) + curve("g", convolved("xs", weights.gaussian(5))),
    "smooth_savgol": savgol(7, 2),
    **{f"noise_{m}": nested(EVENTS, *noisy(m)) + " select spectrum_id, round(noise, 6) as noise from s" for m in NOISE},
    "noise_bins_sd": binned("(b * n // 4) as low, ((b + 1) * n // 4) - 1 as high", "list_aggregate(r[low + 1 : high + 1], 'stddev_samp')"),
    "noise_bins_overlap": binned("greatest(0, floor(b * (n / 2.5::double) * 0.5))::int as low, least(n - 1, ceil(b * (n / 2.5::double) * 0.5 + n / 2.5::double) - 1)::int as high", "list_aggregate(r[low + 1 : high + 1], 'quantile_cont', 0.95)"),
    "snr_spectrum": nested(EVENTS, *noisy("sd"), step("q", "s", "signal", "list_aggregate(xs, 'quantile_cont', 0.95)")) + " select spectrum_id, round(signal, 6) as signal, round(noise, 6) as noise, round(signal / noise, 4) as snr from q",
    "baseline_locmin": nested(EVENTS, *locmin("xs", "g", "l", 2)) + curve("l", "baseline", "baseline"),
    "baseline_locmin_upper": nested(EVENTS, *locmin("xs", "g", "l", 2, True)) + curve("l", "baseline", "baseline"),
    "baseline_snip_m5": snip(5),
    "baseline_corrected": nested(EVENTS, *locmin("xs", "g", "l", 2)) + curve("l", each("greatest(xs[i + 1] - 0.9::double * baseline[i + 1], 0)")),
    **{f"peaks_{m}": nested(EVENTS, *noisy(m)) + picked("s", "xs", 2, "xs[pk.i + 1] / noise >= 2") for m in NOISE},
    "peaks_relheight": nested(LINES, step("h", "g", "top", f"list_max(list_transform(list_filter(range(n), lambda i: {is_peak('xs', 1, 0)}), lambda i: xs[i + 1]))")) + picked("h", "xs", 1, "top > 0 and xs[pk.i + 1] / top >= 0.8"),
    "peaks_prominence": nested(
        EVENTS,
        f"k as (select *, unnest(list_filter(range(n), lambda i: {is_peak('xs', 2, 1)})) as pk from g)",
        "e as (select *, coalesce(list_max(list_filter(range(pk), lambda j: xs[j + 1] > xs[pk + 1])), -1) as a, coalesce(list_min(list_filter(range(pk + 1, n), lambda j: xs[j + 1] > xs[pk + 1])), n) as b from k)",
        "f as (select *, xs[pk + 1] - greatest(list_min(xs[a + 2 : pk + 1]), list_min(xs[pk + 1 : b])) as prominence from e)",
    )
    + " select spectrum_id, pk::int as i, round(prominence, 6) as prominence from f where round(prominence, 6) >= 20",
    "align_resolution": RESOLUTION + " select spectrum_id, round(resolution, 9) as resolution, round(low, 6) as low, round(high, 6) as high from res",
    "align_domain": DOMAIN + " select low, high, step, tolerance from dom",
    "align_bins": BINS + " select bin, round(mz, 9) as mz, cnt as count from bins",
    "align_merge": MERGE + " select seg::int as peak, round(mz, 9) as mz, cnt as count from merged",
    "align_down": MERGE + """, cand as (select p.spectrum_id, m.seg, p.intensity, abs(p.mz - m.mz) / abs(m.mz) as off, p.i from p, merged m, dom
        where p.mz between m.mz * (1 - 1.001 * dom.tolerance) and m.mz * (1 + 1.001 * dom.tolerance) and abs(p.mz - m.mz) / abs(m.mz) <= dom.tolerance)
      select spectrum_id, seg::int as peak, round(arg_min(intensity, {'off': off, 'i': i}), 6) as intensity from cand group by spectrum_id, seg""",
    "align_auto": AUTO + " select spectrum_id, r::int as peak, round(intensity, 6) as intensity from found",
    "align_up": UP + " select spectrum_id, r::int as peak, round(intensity, 6) as intensity from found",
    "smooth_gaussian_ns": neighbour_smoothed(5, False),
    "smooth_bi_ns": neighbour_smoothed(5, True),
    "noise_curve": nested(EVENTS, *noisy("sd"), *NOISE_CURVE) + curve("c5", "along", "noise"),
    "peaks_noise_curve": nested(EVENTS, *noisy("sd"), *NOISE_CURVE) + picked("c5", "xs", 2, "xs[pk.i + 1] / along[pk.i + 1] >= 2"),
    "peaks_pick_prominence": nested(EVENTS, *noisy("sd"), *PROMINENT, "top as (select *, max(xs[pk + 1]) over (partition by spectrum_id) as high from f where prominence >= 20)")
    + " select spectrum_id, pk::int as i, round(ms[pk + 1], 6) as mz, round(xs[pk + 1], 6) as intensity from top where high > 0 and xs[pk + 1] / high >= 0.5 and xs[pk + 1] / noise >= 2",
    "peaks_area": nested(
        EVENTS, *noisy("sd"),
        f"k as (select *, list_reverse(xs) as back, unnest(list_filter(range(n), lambda i: {is_peak('xs', 2, 1)})) as pk from s)",
        *foot("fr", "k", "xs", "pk", "stop"), *foot("fl", "fr", "back", "(n - 1 - pk)", "behind"),
    ) + """ select spectrum_id, pk::int as i, round(coalesce(list_sum(list_transform(range(n - 1 - behind, stop), lambda j: 0.5 * (xs[j + 2] + xs[j + 1]) * (ms[j + 2] - ms[j + 1]))), 0), 6) as area
      from fl where xs[pk + 1] / noise >= 2""",
    "baseline_snip_auto": nested(EVENTS) + """, w as (with recursive s as (
        select spectrum_id, n, xs as y, least((n - 1) // 2, least(100, greatest(10, n // 10))) as p from g
        union all
        select spectrum_id, n, list_transform(range(n), lambda i: case when i >= p and i < n - p then least(y[i + 1], (y[i + 1 - p] + y[i + 1 + p]) / 2) else y[i + 1] end), p - 1 from s where p >= 1)
      select * from s where p = 0), v as (select *, list_transform(y, lambda v: v + 1e-9) as shifted from w)""" + curve("v", "shifted", "value"),
    "mask": f"select distinct x, y from ({PIXELS})",
    "dense_mask": f"""with s as (select * from ({PIXELS})), box as (select max(x) as w, max(y) as h from s)
      select a.x::int as x, b.y::int as y, case when exists (select 1 from s where s.x = a.x and s.y = b.y) then 1 else 0 end as occupied
      from range(1, (select w + 1 from box)) a(x), range(1, (select h + 1 from box)) b(y)""",
    "dedup_summary": f"select count(*) as total, count(distinct (region, xs)) as unique, count(*) - count(distinct (region, xs)) as duplicate from ({PIXELS})",
    "ion_image": f"select x, y, round(list_sum(xs[19 : 23]), 6) as intensity from ({PIXELS})",
    "before_after_metrics": nested(
        EVENTS,
        *noisy("sd"),
        step("bq", "s", "before", "list_aggregate(xs, 'quantile_cont', 0.95) / noise"),
        "bs as (select spectrum_id, xs, ms, n, before from bq)",
        step("ba", "bs", "ys", convolved("xs", weights.gaussian(5))),
        step("a0", "ba", "yg", convolved("ys", weights.gaussian(9, 2.0))),
        step("a1", "a0", "yr", each("abs(yg[i + 1] - ys[i + 1])")),
        step("a2", "a1", "yn", "greatest(coalesce(list_aggregate(yr, 'stddev_samp'), 0.001), 0.001)"),
        step("a3", "a2", "after", "list_aggregate(ys, 'quantile_cont', 0.95) / yn"),
        "f as (select spectrum_id, before, after, unnest(xs) as x, unnest(ys) as y from a3)",
    )
    + " select spectrum_id, round(corr(x, y), 6) as correlation, round(sum(y) / sum(x), 6) as tic_ratio, round(any_value(before), 4) as snr_before, round(any_value(after), 4) as snr_after, round(any_value(after) / any_value(before), 4) as snr_gain from f group by spectrum_id",
    "plot_frame": f"with w as (select * from ({EVENTS}) where mz between 200 and 400) select spectrum_id, i, round(intensity, 6) as intensity, round(greatest(1.05::double * max(intensity) over (partition by spectrum_id), 1), 6) as y_limit from w",
    "pipeline_full": nested(
        EVENTS,
        *locmin("xs", "g", "l", 2),
        step("c", "l", "flat", each("greatest(xs[i + 1] - baseline[i + 1], 0)")),
        step("d", "c", "soft", SMOOTH5),
        step("e", "d", "normed", each("case when list_sum(soft) > 0 then soft[i + 1] * n / list_sum(soft) else 0 end")),
        *noisy("sd", "e", "normed"),
    )
    + picked("s", "normed", 2, "normed[pk.i + 1] / noise >= 2"),
}


def _scores(source: str) -> str:
    """Type evidence of every spectrum, point by point with window functions."""
    return f"""with p as ({source}), a as (select spectrum_id, i, n, mz, abs(intensity) as v, max(abs(intensity)) over (partition by spectrum_id) as top from p),
  f as (select *, v > greatest(top * 1e-6, 2.220446049250313e-16) as big,
      (i = 0 or v >= lag(v) over w) and (i < n - 1 or v > lag(v) over w) and (i = n - 1 or v > lead(v) over w) as high, nullif(greatest(mz - lag(mz) over w, 0), 0) as gap
      from a window w as (partition by spectrum_id order by i)),
  s as (select spectrum_id, any_value(n) as n, any_value(top) as top, count(*) filter (big) as sig, count(*) filter (big and high) as peaks, stddev_pop(gap) / avg(gap) as cv from f group by spectrum_id),
  scores as (select spectrum_id, case when n < 8 then -2.0 else
      (case when sig / greatest(peaks, 1) >= 4 then 3 when sig / greatest(peaks, 1) <= 2.5 then -3 else 0 end)
      + (case when sig / n >= 0.35 then 1 when sig / n <= 0.1 then -1 else 0 end)
      + (case when cv <= 0.25 then 1 when coalesce(cv, 'inf'::double) >= 0.6 then -1 else 0 end) end::double as score
    from s where n < 8 or (top > 0 and sig > 0))"""


ORACLES["type_scores"] = _scores(EVENTS) + " select spectrum_id, score from scores"
ORACLES["infer_type"] = _scores(EMBEDDINGS) + " select count(*) as spectra, round(avg(score), 4) as score, case when avg(score) > 0 then 'profile' else 'centroid' end as spectrum_type from scores"
#: Picking at radius 1 on the points themselves, then the alignment of what is left.
ORACLES["pipeline_aligned"] = (AUTO + " select spectrum_id, r::int as peak, round(ref, 9) as mz, round(intensity, 6) as intensity from found").replace(
    f"with p as ({LINES})",
    f"""with q as (select *, lag(intensity) over (partition by spectrum_id order by i) as before, lead(intensity) over (partition by spectrum_id order by i) as after from ({LINES})),
  p as (select spectrum_id, i, mz, intensity from q where i >= 1 and before < intensity and coalesce(after, '-inf'::double) <= intensity)""",
)

#: Blocks of the filled axis: every spectrum with every block, also those that it doesn't reach.
ORACLES["align_dense"] = AUTO + """, blocks as (select r // 1000 as block, count(*)::int as n from refs group by 1)
  select g.spectrum_id, b.block::int as block, any_value(b.n) as "references", count(f.intensity) filter (f.intensity <> 0)::int as reached, round(coalesce(sum(f.intensity order by f.r), 0), 6) as total
  from g cross join blocks b left join found f on f.spectrum_id = g.spectrum_id and f.r // 1000 = b.block group by g.spectrum_id, b.block"""
SHIFTED = """select vec_id as spectrum_id, unnest(range(len(embedding)))::int as i, len(embedding)::int as n,
  100 + 0.5::double * unnest(range(len(embedding))) + (vec_id % 3) * 0.01::double as mz, abs(unnest(embedding)::double) as intensity from embeddings"""
ORACLES["align_shared_axis"] = AUTO.replace(LINES, SHIFTED).replace("(step * 2)", "(step * 0.6)") + " select spectrum_id, r::int as peak, round(intensity, 6) as intensity from found"
ORACLES["imzml_round_trip"] = f"select (spectrum_id % 25 + 1)::int as x, (spectrum_id // 25 + 1)::int as y, i, round(mz, 6) as mz, round(intensity, 6) as intensity from ({SHIFTED})"
ORACLES["imzml_window"] = f"select x, y, round(list_sum(xs), 6) as total from ({PIXELS}) where x between 3 and 12 and y in (2, 4, 6)"
ORACLES["imzml_layout"] = f"""select x, y, len(xs)::bigint as mz_length, (8 * len(xs))::bigint as mz_bytes, '<f8' as mz_type, len(xs)::bigint as intensity_length, (4 * len(xs))::bigint as intensity_bytes,
  '<f4' as intensity_type from ({PIXELS})"""
ORACLES["tiles_window"] = f"select spectrum_id, x, y, region, round(list_sum(xs), 6) as total from ({PIXELS}) where x between 3 and 12 and y between 2 and 6"
#: The natural cubic spline through every fifth value of the baseline: elimination forth, substitution back, a step a row.
ORACLES["baseline_spline"] = nested(EVENTS, *locmin("xs", "g", "l", 2)) + """,
  kn as (select spectrum_id, n, baseline, list_sort(list_distinct(list_concat(range(0, n, 5), [n - 1]))) as t from l),
  ky as (select spectrum_id, n, t, len(t) as k, list_transform(t, lambda q: baseline[q + 1]) as y from kn),
  forth as (with recursive f as (
      select spectrum_id, n, t, y, k, 1 as i, [0.0::double] as c, [0.0::double] as d from ky
      union all
      select spectrum_id, n, t, y, k, i + 1, list_append(c, (t[i + 2] - t[i + 1]) / (2.0::double * (t[i + 2] - t[i]) - (t[i + 1] - t[i]) * c[i])),
        list_append(d, (6 * ((y[i + 2] - y[i + 1]) / (t[i + 2] - t[i + 1]) - (y[i + 1] - y[i]) / (t[i + 1] - t[i])) - (t[i + 1] - t[i]) * d[i]) / (2.0::double * (t[i + 2] - t[i]) - (t[i + 1] - t[i]) * c[i]))
      from f where i <= k - 2)
    select * from f where i = k - 1),
  back as (with recursive b as (
      select spectrum_id, n, t, y, k, c, d, k - 2 as i, [0.0::double] as m from forth
      union all
      select spectrum_id, n, t, y, k, c, d, i - 1, list_prepend(case when i = 0 then 0.0::double else d[i + 1] - c[i + 1] * m[1] end, m) from b where i >= 0)
    select * from b where i = -1),
  cells as (select *, list_transform(range(n), lambda q: least(len(list_filter(t, lambda s: s <= q)), k - 1)) as js from back),
  splined as (select *, list_transform(range(n), lambda q:
      (m[js[q + 1]] * pow(t[js[q + 1] + 1] - q, 3) + m[js[q + 1] + 1] * pow(q - t[js[q + 1]], 3)) / (6 * (t[js[q + 1] + 1] - t[js[q + 1]]))
      + (y[js[q + 1]] / (t[js[q + 1] + 1] - t[js[q + 1]]) - m[js[q + 1]] * (t[js[q + 1] + 1] - t[js[q + 1]]) / 6) * (t[js[q + 1] + 1] - q)
      + (y[js[q + 1] + 1] / (t[js[q + 1] + 1] - t[js[q + 1]]) - m[js[q + 1] + 1] * (t[js[q + 1] + 1] - t[js[q + 1]]) / 6) * (q - t[js[q + 1]])) as s from cells)""" + curve("splined", "s", "baseline")
#: Plateau maxima, their prominence, the crossings of half of it, and Simpson's rule over the points between.
_AT = "{ls}[floor({a})::int + 1] + ({a} - floor({a})) * (coalesce({ls}[floor({a})::int + 2], {ls}[floor({a})::int + 1]) - {ls}[floor({a})::int + 1])"
_STEP = "(ts[q + 3] - ts[q + 1]) / 6 * ((2 - (ts[q + 3] - ts[q + 2]) / (ts[q + 2] - ts[q + 1])) * ys[q + 1] + pow(ts[q + 3] - ts[q + 1], 2) / ((ts[q + 2] - ts[q + 1]) * (ts[q + 3] - ts[q + 2])) * ys[q + 2] + (2 - (ts[q + 2] - ts[q + 1]) / (ts[q + 3] - ts[q + 2])) * ys[q + 3])"
ORACLES["peaks_origin"] = nested(
    EVENTS, *noisy("sd"),
    "o0 as (select *, unnest(list_filter(range(1, n - 1), lambda i: xs[i] < xs[i + 1])) as pi from s)",
    "o1 as (select *, list_min(list_filter(range(pi, n - 1), lambda q: xs[q + 2] <> xs[pi + 1])) as pj from o0)",
    "k as (select *, (pi + pj) // 2 as pk from o1 where pj is not null and xs[pj + 2] < xs[pi + 1] and xs[pi + 1] >= 0.012::double * list_max(xs))",
    *PROMINENT[1:],
    "h as (select *, xs[pk + 1] - 0.5::double * prominence as lv from f)",
    "c as (select *, coalesce(list_max(list_filter(range(pk + 1), lambda q: xs[q + 1] <= lv)), 0) as li, coalesce(list_min(list_filter(range(pk, n), lambda q: xs[q + 1] <= lv)), n - 1) as ri from h)",
    "w as (select *, case when xs[li + 1] < lv then li + (lv - xs[li + 1]) / (xs[li + 2] - xs[li + 1]) else li::double end as lf, case when xs[ri + 1] < lv then ri - (lv - xs[ri + 1]) / (xs[ri] - xs[ri + 1]) else ri::double end as rf from c)",
    "v as (select *, list_filter(range(n), lambda q: q > lf and q < rf) as inn from w where rf - lf >= 2 and xs[pk + 1] > 2 * noise)",
    f"u as (select *, list_concat([{_AT.format(ls='ms', a='lf')}], list_transform(inn, lambda q: ms[q + 1]), [{_AT.format(ls='ms', a='rf')}]) as ts, list_concat([{_AT.format(ls='xs', a='lf')}], list_transform(inn, lambda q: xs[q + 1]), [{_AT.format(ls='xs', a='rf')}]) as ys from v)",
    "z as (select *, len(ts) as m, ts[len(ts) - 1] - ts[len(ts) - 2] as g0, ts[len(ts)] - ts[len(ts) - 1] as g1 from u)",
) + f""" select spectrum_id, pk::int as i, round(ms[pk + 1], 6) as mz, round(xs[pk + 1], 6) as intensity,
  round(case when m = 2 then 0.5 * (ts[2] - ts[1]) * (ys[1] + ys[2]) else list_sum(list_transform(range(0, m - 2, 2), lambda q: {_STEP}))
    + case when m % 2 = 0 then ys[m] * (2 * pow(g1, 2) + 3 * g0 * g1) / (6 * (g0 + g1)) + ys[m - 1] * (pow(g1, 2) + 3 * g0 * g1) / (6 * g0) - ys[m - 2] * pow(g1, 3) / (6 * g0 * (g0 + g1)) else 0 end end, 6) as area from z"""  # fmt: skip
def lowess(base: str, y: str, axis: str, span: float) -> list[str]:
    """Steps to a table ``smoothed`` with a list ``value``: anchors a hundredth of the range apart, windows around them with
    their tricube weights, then a fit a row of recursion, each with the bisquare weights of the one before."""
    weighed = "list_transform(range(a.lo, a.hi), lambda j: a.tri[j - a.lo + 1] * robust[j + 1])"
    fits = f"""list_transform(list_transform(list_transform(places, lambda a: {{'a': a, 'w': {weighed}}}), lambda b: {{'a': b.a, 'w': b.w, 'sw': list_sum(b.w)}}), lambda b:
        case when b.sw <= 0 then ys[b.a.i + 1] else list_sum(list_transform(range(b.a.lo, b.a.hi), lambda j: b.w[j - b.a.lo + 1] / b.sw * ys[j + 1]))
          + coalesce((list_sum(list_transform(range(b.a.lo, b.a.hi), lambda j: b.w[j - b.a.lo + 1] / b.sw * ys[j + 1] * (ax[j + 1] - list_sum(list_transform(range(b.a.lo, b.a.hi), lambda q: b.w[q - b.a.lo + 1] / b.sw * ax[q + 1])))))
            * (ax[b.a.i + 1] - list_sum(list_transform(range(b.a.lo, b.a.hi), lambda q: b.w[q - b.a.lo + 1] / b.sw * ax[q + 1])))
            / nullif(list_sum(list_transform(range(b.a.lo, b.a.hi), lambda j: b.w[j - b.a.lo + 1] / b.sw * pow(ax[j + 1], 2))) - pow(list_sum(list_transform(range(b.a.lo, b.a.hi), lambda j: b.w[j - b.a.lo + 1] / b.sw * ax[j + 1])), 2), 0)), 0) end)"""
    along = "list_transform(range(n), lambda q: case when seat[q + 1].p = seat[q + 1].r then fit[seat[q + 1].p] else fit[seat[q + 1].p] + (fit[seat[q + 1].r] - fit[seat[q + 1].p]) * (ax[q + 1] - ax[spots[seat[q + 1].p] + 1]) / (ax[spots[seat[q + 1].r] + 1] - ax[spots[seat[q + 1].p] + 1]) end)"
    return [
        f"w0 as (select spectrum_id, n, {axis} as ax0, {y} as ys, greatest(2, least(n, floor({span} * n + 1e-7)::int)) as k from {base})",
        # the axis from its start, so that squares lose nothing
        "w1 as (select spectrum_id, n, ys, k, list_transform(ax0, lambda v: v - ax0[1]) as ax from w0)",
        """wa as (with recursive r as (
          select spectrum_id, n, ax, 0 as last from w1
          union all
          select spectrum_id, n, ax, greatest(last + 1, least(len(list_filter(ax, lambda v: v <= ax[last + 1] + 0.01::double * ax[n])) - 1, n - 1))::int as last from r where last < n - 1)
        select spectrum_id, list(last order by last) as spots from r group by spectrum_id)""",
        "w2 as (select w1.*, spots, list_transform(range(n), lambda q: {'p': len(list_filter(spots, lambda s: s <= q)), 'r': len(list_filter(spots, lambda s: s < q)) + 1}) as seat from w1 join wa using (spectrum_id))",
        "w3 as (select *, list_transform(spots, lambda i: {'i': i, 'lo': len(list_filter(range(n - k), lambda s: ax[i + 1] - ax[s + 1] > ax[s + k + 1] - ax[i + 1]))}) as los from w2)",
        "w4 as (select *, list_transform(los, lambda a: {'i': a.i, 'lo': a.lo, 'h': greatest(ax[a.i + 1] - ax[a.lo + 1], ax[a.lo + k] - ax[a.i + 1])}) as hs from w3)",
        "w5 as (select *, list_transform(hs, lambda a: {'i': a.i, 'lo': a.lo, 'h': a.h, 'hi': greatest(a.lo + k, len(list_filter(ax, lambda v: v <= ax[a.i + 1] + 0.999::double * a.h)))}) as his from w4)",
        """w6 as (select *, list_transform(his, lambda a: {'i': a.i, 'lo': a.lo, 'hi': a.hi, 'tri': list_transform(range(a.lo, a.hi), lambda j:
          case when abs(ax[j + 1] - ax[a.i + 1]) <= 0.001::double * a.h then 1 when abs(ax[j + 1] - ax[a.i + 1]) <= 0.999::double * a.h then pow(1 - pow(abs(ax[j + 1] - ax[a.i + 1]) / a.h, 3), 3) else 0 end)}) as places from w5)""",
        f"""fitted as (with recursive r as (
          select spectrum_id, n, ys, ax, spots, seat, places, 0 as step, list_transform(range(n), lambda q: 1.0::double) as robust, null::double[] as value from w6
          union all
          select spectrum_id, n, ys, ax, spots, seat, places, step + 1, list_transform(ys, lambda v, q:
              case when abs(v - new[q]) <= 0.001::double * cap then 1 when abs(v - new[q]) <= 0.999::double * cap then pow(1 - pow(abs(v - new[q]) / cap, 2), 2) else 0 end), new
          from (select *, 6 * list_aggregate(list_transform(ys, lambda v, q: abs(v - new[q])), 'median') as cap from (
            select *, {along} as new from (select *, {fits} as fit from r where step < 4))))
        select * from r where step = 4)""",
        "smoothed as (select spectrum_id, n, value from fitted)",
    ]


#: Asymmetric least squares: the factors of a system with two bands place by place, then the substitution back, fifteen times.
_D0 = "(case when i <= n - 3 then 1 else 0 end + case when i >= 1 and i <= n - 2 then 4 else 0 end + case when i >= 2 then 1 else 0 end)"
_D1 = "(case when i <= n - 2 then -2 else 0 end + case when i >= 2 then -2 else 0 end)"  # between i - 1 and i
_E2 = "(case when i >= 2 then 1e4::double / d[i - 1] else 0 end)"
_E1 = f"(case when i >= 1 then (1e4::double * {_D1} - (case when i >= 2 then {_E2} * l1[i] * d[i - 1] else 0 end)) / d[i] else 0 end)"
ORACLES["baseline_asls"] = nested(EVENTS) + f""", solved as (with recursive r as (
    select spectrum_id, n, xs, 0 as turn, 0 as i, true as forth, list_transform(xs, lambda v: 1.0::double) as w, []::double[] as d, []::double[] as l1, []::double[] as l2, []::double[] as z, []::double[] as o from g
    union all
    select spectrum_id, n, xs, case when not forth and i < 0 then turn + 1 else turn end,
      case when forth then (case when i = n - 1 then n - 1 else i + 1 end) when i < 0 then 0 else i - 1 end,
      case when forth then i < n - 1 else i < 0 end,
      case when not forth and i < 0 then list_transform(xs, lambda v, k: case when v > o[k] then 0.01::double else 0.99::double end) else w end,
      case when forth then list_append(d, w[i + 1] + 1e4::double * {_D0} - (case when i >= 1 then {_E1} * {_E1} * d[i] else 0 end) - (case when i >= 2 then {_E2} * {_E2} * d[i - 1] else 0 end)) when i < 0 then [] else d end,
      case when forth then list_append(l1, {_E1}) when i < 0 then [] else l1 end,
      case when forth then list_append(l2, {_E2}) when i < 0 then [] else l2 end,
      case when forth then list_append(z, w[i + 1] * xs[i + 1] - (case when i >= 1 then {_E1} * z[i] else 0 end) - (case when i >= 2 then {_E2} * z[i - 1] else 0 end)) when i < 0 then [] else z end,
      case when forth then [] when i < 0 then o else list_prepend(z[i + 1] / d[i + 1] - (case when i + 1 < n then l1[i + 2] * o[1] else 0 end) - (case when i + 2 < n then l2[i + 3] * o[2] else 0 end), o) end
    from r where not (turn = 14 and not forth and i < 0))
  select * from r where turn = 14 and not forth and i < 0)""" + curve("solved", "o", "value")
#: Wavelet shrinkage: levels down by filters over mirrored edges, the universal threshold, levels up again.
_LOW = [float(c) for c in kernels.WAVELETS["db4"]]
_HIGH = [(-1) ** k * c for k, c in enumerate(_LOW[::-1])]
_EDGE = "a[case when q < 0 then -q when q >= len(a) then 2 * len(a) - q else q + 1 end]"


def _down(kernel: list[float]) -> str:
    terms = " + ".join(f"{c!r}::double * {_EDGE.replace('q', f'(2 * t + 1 + {j} - 7)')}" for j, c in enumerate(kernel))
    return f"list_transform(range((len(a) + 7) // 2), lambda t: {terms})"


def _up(kernel: list[float], of: str, length: str) -> str:
    """Zeros between the samples, then the filter; sample t + 6 of the whole."""
    return " + ".join(f"case when (t + 6 - {j}) % 2 = 0 and t + 6 - {j} >= 0 and (t + 6 - {j}) // 2 < {length} then {c!r}::double * {of}[(t + 6 - {j}) // 2 + 1] else 0 end" for j, c in enumerate(kernel))


ORACLES["smooth_wavelet"] = nested(EVENTS) + f""", downs as (with recursive r as (
    select spectrum_id, n, floor(log2(n / 7.0::double))::int as depth, 0 as level, xs as a, []::double[][] as ds, []::bigint[] as lens from g
    union all
    select spectrum_id, n, depth, level + 1, {_down(_LOW)}, list_append(ds, {_down(_HIGH)}), list_append(lens, len(a)) from r where level < depth)
  select * from r where level = depth),
  limits as (select *, list_aggregate(list_transform(ds[1], lambda v: abs(v)), 'median') / 0.6745::double * sqrt(2 * ln(n)) as cap from downs),
  ups as (with recursive r as (
    select spectrum_id, n, level, a, ds, lens, cap from limits
    union all
    select spectrum_id, n, level - 1, list_transform(range(lens[level]), lambda t: {_up(_LOW, "a", "len(soft)")} + {_up(_HIGH, "soft", "len(soft)")}), ds, lens, cap
    from (select *, list_transform(ds[level], lambda v: sign(v) * greatest(abs(v) - cap, 0)) as soft from r where level > 0))
  select * from r where level = 0)""" + curve("ups", "a", "value")
#: Bins that follow the signal: join the pair of least error, cut the worst bin where two lines fit best, while the error falls.
_SUMS = {"sx": "xs[j]", "stx": "(j - 1) * xs[j]", "sxx": "xs[j] * xs[j]", "st": "(j - 1)::double", "stt": "pow(j - 1, 2)::double"}


def _error(a: str, b: str) -> str:
    n, t, tt, x, tx, xx = f"greatest({b} - {a}, 1)", *(f"({c}[{b} + 1] - {c}[{a} + 1])" for c in ("st", "stt", "sx", "stx", "sxx"))
    ct, cx = f"({tt} - {t} * {t} / {n})", f"({tx} - {t} * {x} / {n})"
    return f"greatest({xx} - {x} * {x} / {n} - case when {ct} > 0 then {cx} * {cx} / {ct} else 0 end, 0)"


def _errors(edges: str) -> str:
    return f"list_transform(range(len({edges}) - 1), lambda k: {_error(f'{edges}[k + 1]', f'{edges}[k + 2]')})"


ORACLES["noise_bins_dynamic"] = nested(
    EVENTS, *noisy("sd"),
    "q0 as (select spectrum_id, n, xs, r, list_sort(list_distinct([0, n // 4, 2 * n // 4, 3 * n // 4, n])) as e, "
    + ", ".join(f"list_transform(range(n + 1), lambda m: coalesce(list_sum(list_transform(range(1, m + 1), lambda j: {v})), 0)::double) as {c}" for c, v in _SUMS.items()) + " from s)",
) + f""", moved as (with recursive w as (
    select *, 0 as turn, false as done from q0
    union all
    select spectrum_id, n, xs, r, case when better then new else e end, {", ".join(_SUMS)}, turn + 1, not better
    from (select *, worst is not null and list_sum({_errors("new")}) < list_sum(best) as better
      from (select *, list_concat(joined[1:worst], [lo + list_position(splits, list_min(splits))], joined[worst + 1:]) as new
        from (select *, list_transform(range(lo + 1, hi), lambda c: {_error("lo", "c")} + {_error("c", "hi")}) as splits
          from (select *, joined[worst] as lo, joined[worst + 1] as hi
            from (select *, list_position(wide, list_max(wide)) as worst
              from (select *, list_transform({_errors("joined")}, lambda v, k: case when joined[k + 1] - joined[k] >= 2 then v end) as wide
                from (select *, list_concat(e[1:list_position(pairs, list_min(pairs))], e[list_position(pairs, list_min(pairs)) + 2:]) as joined
                  from (select *, list_transform(range(len(best) - 1), lambda k: best[k + 1] + best[k + 2]) as pairs
                    from (select *, {_errors("e")} as best from w where turn < 10 and not done)))))))))
    )
  select spectrum_id, r, arg_max(e, turn) as e from w group by spectrum_id, r),
  bins as (select spectrum_id, r, unnest(list_transform(range(len(e) - 1), lambda k: {{'low': e[k + 1], 'stop': e[k + 2]}})) as b from moved)
select spectrum_id, b.low::int as low, (b.stop - 1)::int as high, round(greatest(coalesce(list_aggregate(r[b.low + 1 : b.stop], 'stddev_samp'), 0.001), 0.001), 6) as noise from bins"""
ORACLES["baseline_lowess"] = nested(EVENTS, *lowess("g", "xs", "ms", 0.3)) + curve("smoothed", "value", "value")
ORACLES["baseline_locmin_lowess"] = nested(EVENTS, *locmin("xs", "g", "l", 2), *lowess("l", "baseline", "list_transform(range(n), lambda q: q::double)", 0.2)) + curve("smoothed", "value", "baseline")
for _name in ("norm_tic", "norm_rms", "norm_ref", "norm_median", "smooth_ma", "smooth_gaussian", "smooth_savgol", "baseline_locmin", "baseline_snip_m5", "pipeline_full", "peaks_sd", "peaks_quantile"):
    ORACLES[f"{_name}_points"] = ORACLES[_name]

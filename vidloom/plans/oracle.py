"""SQL for DuckDB that gives the rows of the queries in ``catalog``."""

from __future__ import annotations

#: Threshold of the early stop query.
EARLY_THRESHOLD = 0.42

# Building blocks -------------------------------------------------------------------------------


def norm_path(c: str) -> str:
    return f"coalesce(nullif(lower(regexp_replace(replace(trim({c}), '\\', '/'), '/+$', '')), ''), '-')"


def identity(c: str) -> str:
    x = f"lower(rtrim(replace(trim({c}), '\\', '/'), '/'))"
    return f"(case when trim({x}) <> '' then {x} end)"


def ratio(c: str) -> str:
    return f"(case when {c} is not null and not isnan({c}) then greatest(0.0, least(1.0, case when {c} > 1 and {c} <= 100 then {c} / 100 else {c} end)) end)"


def bits(c: str) -> str:
    u = f"(('0x' || lower(trim({c})))::ubigint)"
    return f"(case when regexp_matches(lower(trim({c})), '^[0-9a-f]{{16}}$') then (case when {u} >= 9223372036854775808::ubigint then ({u}::hugeint - 18446744073709551616::hugeint)::bigint else {u}::bigint end) end)"


def relation_case(a: str, b: str, least: float, tail: str) -> str:
    def longer(x: str, y: str) -> str:
        return f"((duration_{x} > 0 and duration_{y} > 0 and duration_{x} >= duration_{y} * 1.35) or (total_frames_{x} > 0 and total_frames_{y} > 0 and total_frames_{x} >= total_frames_{y} * 1.35))"

    return f"""case when {longer("a", "b")} and {b} >= 0.65 then 'B_is_likely_clip_of_A' when {longer("b", "a")} and {a} >= 0.65 then 'A_is_likely_clip_of_B'
  when {b} >= {least} and {b} - {a} >= 0.18 then 'B_is_likely_clip_of_A' when {a} >= {least} and {a} - {b} >= 0.18 then 'A_is_likely_clip_of_B' {tail} end"""


ENGINE = relation_case("a_in_b", "b_in_a", 0.85, "when a_in_b >= 0.8 and b_in_a >= 0.8 then 'near_duplicate_or_same_content' when greatest(a_in_b, b_in_a) >= 0.5 then 'partial_overlap' else 'different'")
REPORT = relation_case("a_in_b", "b_in_a", 0.75, "when a_in_b >= 0.8 and b_in_a >= 0.8 then 'near_duplicate_or_same_content' when greatest(a_in_b, b_in_a) > 0.3 then 'partial_overlap' when greatest(a_in_b, b_in_a) > 0.1 then 'similar' else 'different'")

LABELS = "frames_ as (select label video_id, row_number() over (partition by label order by vec_id) - 1 pos, embedding::double[] e from embeddings)"

CLIPS = """shapes as (select * from (values ('v', 30, 0, 75), ('c', 60, 10, 30), ('n', 150, 0, 72)) t(letter, step, base, size)),
frames_ as (select letter || printf('%06d', k) video_id, vec_id - base - k * step pos, ((vec_id - base - k * step) * 0.5)::double ts, embedding::double[] e from (
  select s.*, e.*, unnest(range(greatest(0, ceil((vec_id - base - size + 1) / step)::bigint), floor((vec_id - base) / step)::bigint + 1)) k from embeddings e, shapes s where vec_id >= base))"""


def sims(k: int, pairs: str = "") -> str:
    """Best k targets of each frame for every pair of videos (or those of the table ``pairs``), both directions."""
    only = f" join {pairs} p on p.a = x.video_id and p.b = y.video_id" if pairs else ""
    return f"""cos as (select x.video_id a, y.video_id b, x.pos pa, y.pos pb, round(list_cosine_similarity(x.e, y.e), 6) s from frames_ x join frames_ y on x.video_id < y.video_id{only}),
both_ways as (select a, b, 'A_to_B' direction, pa src, pb tgt, s sim from cos union all select a, b, 'B_to_A', pb, pa, s from cos),
ranked as (select *, row_number() over (partition by a, b, direction, src order by sim desc, tgt) as rank from both_ways),
sims as (select * from ranked where rank <= {k})"""


def fold(keys: str, source: str, tolerance: float = 3.0) -> str:
    """Greedy clusters by running mean of the offsets of ``source`` (keys, src_ts, tgt_ts, ...)."""
    eq = " and ".join(f"o.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    eq2 = " and ".join(f"m.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    o_keys = ", ".join(f"o.{k.strip()}" for k in keys.split(","))
    return f"""timed as (select *, round(tgt_ts - src_ts, 6) + 0.0 as off from {source} where src_ts is not null and tgt_ts is not null and not isnan(src_ts) and not isnan(tgt_ts)),
offs as materialized (select *, row_number() over (partition by {keys} order by off) rn from (select {keys}, off, count(*) n from timed group by {keys}, off)),
walk as (select {keys}, off, rn, off * n total, n cnt, 0 cluster from offs where rn = 1 union all
  select {o_keys}, o.off, o.rn, case when abs(o.off - r.total / r.cnt) <= {tolerance} then r.total + o.off * o.n else o.off * o.n end,
  case when abs(o.off - r.total / r.cnt) <= {tolerance} then r.cnt + o.n else o.n end, case when abs(o.off - r.total / r.cnt) <= {tolerance} then r.cluster else r.cluster + 1 end
  from walk r join offs o on {eq} and o.rn = r.rn + 1),
clustered as (select m.*, c.cluster from timed m join walk c on {eq2} and m.off = c.off),
clusters as (select {keys}, cluster, count(*) n, count(distinct src) frames, min(src_ts) ss, max(src_ts) se, min(tgt_ts) ts, max(tgt_ts) te, avg(sim) s, stddev_pop(off) sd from clustered group by {keys}, cluster)"""


def coverage(keys: str) -> str:
    eq = " and ".join(f"c.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    f_keys = ", ".join(f"f.{k.strip()}" for k in keys.split(","))
    return f"""facts as (select {keys}, max(total) total, count(*) every from timed group by {keys}),
scored as (select {f_keys}, f.total, c.frames, c.cluster, round(c.frames * greatest(0.0, c.s), 9) score, c.n >= least(3, f.every, f.total) and (f.total <= 3 or greatest(c.se - c.ss, c.te - c.ts) >= 1.0) valid from facts f join clusters c on {eq}),
covered as (select {keys}, case when max(total) > 0 then least(1.0, coalesce(arg_max(frames, (score, -cluster)) filter (where valid and score > 0), 0) / max(total)) else 0 end coverage from scored group by {keys})"""


MATCHES = f"""once as (select match_id, pair_id, direction, source_frame_index src, {ratio("similarity")} sim, max(target_frame_index) tgt, max(source_timestamp) src_ts, max(target_timestamp) tgt_ts
  from frame_matches where source_frame_index is not null and similarity is not null and not isnan(similarity) group by 1, 2, 3, 4, 5),
sizes as (select pair_id, max(total_frames_a) fa, max(total_frames_b) fb from report_pairs group by 1),
matches as (select o.*, case when direction = 'A_to_B' then fa else fb end total from once o join sizes using (pair_id))"""

CLIP_COUNTS = "counts as (select video_id, count(*) n, max(ts) d from frames_ group by 1)"
#: As the pipeline query says them: copies state a duration, clips an unusable one.
STATED = CLIP_COUNTS.replace("max(ts) d", "case when any_value(video_id) like 'n%' then 40.0 else max(ts) end d")


def clip_matches(pairs: str = "", counts: str = CLIP_COUNTS) -> str:
    return f"""{sims(10, pairs)}, {counts},
matches as (select a, b, direction, src, tgt, x.ts src_ts, y.ts tgt_ts, sim, n.n total from sims
  join frames_ x on x.video_id = case when direction = 'A_to_B' then a else b end and x.pos = src join frames_ y on y.video_id = case when direction = 'A_to_B' then b else a end and y.pos = tgt
  join counts n on n.video_id = x.video_id where sim >= 0.65)"""


def candidates(limit: int) -> str:
    """Table ``cands`` of the candidate pairs of clips."""
    return f"""c_counts as (select video_id, count(*) n from frames_ group by 1),
pooled as (select video_id, floor(greatest(0, ts) / 30) bucket, list(v order by i) v from (select video_id, ts_b, ts, i, avg(x) over (partition by video_id, ts_b, i) v, row_number() over (partition by video_id, ts_b, i order by ts) rn
  from (select video_id, ts, floor(greatest(0, ts) / 30) ts_b, unnest(range(64)) i, unnest(e) x from frames_)) where rn = 1 group by video_id, floor(greatest(0, ts) / 30)),
wins as (select video_id, 'w' || (row_number() over (partition by video_id order by bucket) - 1) item, v from pooled),
spots as (select distinct video_id, case when c > 1 then floor(i * (n - 1) / (c - 1)) else 0 end pos from (select video_id, n, least(64, n) c, unnest(range(least(64, n))) i from c_counts)),
asks as (select f.video_id, 'f' || f.pos item, e v from frames_ f join spots s on s.video_id = f.video_id and s.pos = f.pos union all select video_id, item, v from wins),
idx as (select video_id, 'f' || pos item, e v from frames_ union all select video_id, item, v from wins),
near as (select a.video_id src, a.item query, i.video_id tgt, i.video_id || '|' || i.item tie, round(list_cosine_similarity(a.v, i.v), 6) sim from asks a, idx i),
top as (select * from (select *, row_number() over (partition by src, query order by sim desc, tie) rn from near) where rn <= {max(128, 16 * limit)} and src <> tgt),
best as (select src, tgt, query, max(sim) s from top group by 1, 2, 3 having max(sim) > 0),
lists as (select src, tgt, list(s order by s desc) q, any_value(k.n) n from best join (select video_id, count(*) n from asks group by 1) k on k.video_id = src group by 1, 2),
c_scored as (select src, tgt, round(len(list_filter(q, lambda x: x >= 0.65)) / n * 2.0 + len(list_filter(q, lambda x: x >= 0.49)) / n * 1.25 + list_sum(q[1:greatest(1, n // 4)]) / greatest(1, n // 4) + q[1] * 0.25, 9) score from lists),
c_chosen as (select distinct least(src, tgt) a, greatest(src, tgt) b from (select *, row_number() over (partition by src order by score desc, tgt) place from c_scored) where place <= {limit}),
cands as materialized (select * from c_chosen where {limit} < (select count(*) - 1 from c_counts) union select x.video_id, y.video_id from c_counts x join c_counts y on x.video_id < y.video_id where {limit} >= (select count(*) - 1 from c_counts))"""


SEGMENT = """(se - ss) duration, case when se > ss then least(1.0, n / greatest(1.0, se - ss)) else 1.0 end coverage, 0.4 * least(1.0, n / 10) + 0.4 * s + 0.2 * greatest(0.0, 1 - case when n > 1 then sd else 0 end / 10) confidence"""

LINES = "lines as (select doc_id video, unnest(range(len(l)::int)) line_no, unnest(l) line from (select doc_id, string_split(text, chr(10)) l from documents where text is not null))"


def has(c: str, parts: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({c}, '{p}')" for p in parts) + ")"


IMPORTANT = "(" + " or ".join(f"starts_with(lower(trim(line)), '{p}')" for p in ("warning:", "error:", "traceback")) + " or " + has("lower(trim(line))", ("failed to index", "failed to compare", "failed to process", "cannot open video", "no frames retained", "exception", "失败", "错误", "无法打开")) + ")"
NOISE = "((contains(line, 'swscaler') and contains(line, 'Slice parameters') and contains(line, 'invalid')) or (contains(line, 'deprecated pixel format used') and contains(line, 'swscaler')) or (contains(line, 'video_reader.cc:711') and contains(line, 'Failed to skip frames effectively') and contains(line, 'Decoder did not respond after 10000 attempts')))"
HIDDEN_TEXT = "(" + " or ".join(f"starts_with(trim(line), '{p}')" for p in ("Loading weights:", "ANALYSIS_VIDEO_CONTEXT|", "ANALYSIS_VIDEO_QUARANTINED|", "[transformers]", "Key", "----", "Notes:")) + " or " + has("trim(line)", ("UNEXPECTED", "can be ignored when loading", "requires torchvision", "HF_TOKEN", "unauthenticated requests to the HF Hub")) + f" or {NOISE})"
HIDDEN = f"(trim(line) = '' or (not {IMPORTANT} and {HIDDEN_TEXT}))"


def present(c: str) -> str:
    return f"(case when {c} is not null and not isnan({c}) then {c} end)"


NORMAL = f"""deduped as (select pair_id, any_value(completed_at) completed_at, coalesce(any_value(video_a), '') va, coalesce(any_value(video_b), '') vb, coalesce(any_value(video_a_path), '') pa, coalesce(any_value(video_b_path), '') pb,
  any_value(a_in_b) ra, any_value(b_in_a) rb, any_value(symmetric_similarity) rs, coalesce(any_value(relation), '') rel, coalesce({present("any_value(total_frames_a)::double")}, 0) total_frames_a, coalesce({present("any_value(total_frames_b)::double")}, 0) total_frames_b,
  coalesce({present("any_value(duration_a)")}, 0) duration_a, coalesce({present("any_value(duration_b)")}, 0) duration_b, coalesce(any_value(matched_segment_count), 0) segs, coalesce(any_value(matches_a_to_b_total), 0) ma, coalesce(any_value(matches_b_to_a_total), 0) mb
  from report_pairs group by pair_id),
sided as (select *, case when pa <> '' then pa else va end x, case when pb <> '' then pb else vb end y, {ratio("ra")} a_in_b, {ratio("rb")} b_in_a, {ratio("rs")} symmetric_similarity, case when rel = '' then 'unknown' else rel end reported from deduped),
derived as (select *, {norm_path("x")} kx, {norm_path("y")} ky, {REPORT} made from sided),
normal as (select *, least(kx, ky) || '||' || greatest(kx, ky) pair_key, case when reported in ('identical', 'identical_file') or a_in_b is null or b_in_a is null then reported
  when made like '%clip%' or reported in ('A_is_likely_clip_of_B', 'B_is_likely_clip_of_A', 'a_contains_b', 'b_contains_a', 'unknown') then made else reported end relation,
  coalesce(nullif(va, ''), nullif(regexp_extract(replace(x, '\\', '/'), '[^/]*$'), ''), '-') video_a, coalesce(nullif(vb, ''), nullif(regexp_extract(replace(y, '\\', '/'), '[^/]*$'), ''), '-') video_b from derived)"""

VIDEOS = "v as (select distinct scan_id, video_path path, video_name as name, extension, size_bytes, size_mb, modified_at_ms from videos)"

DURATIONS = f"""lens as (select path, max(case when x > 0 and not isnan(x) then x end) duration from (select {norm_path("p")} path, x from (
  select video_a_path p, duration_a x from report_pairs union all select video_b_path, duration_b from report_pairs) where p is not null) where path <> '-' group by path)"""

EVENT_CLIPS = "clips as (select o_custkey composition, o_orderkey % 3 track, o_orderkey clip, datediff('day', date '1990-01-01', o_orderdate::date)::double s, datediff('day', date '1990-01-01', o_orderdate::date) + 1 + floor(o_totalprice / 1000) e, o_orderpriority from orders)"

WARNINGS = """marked as (select user_id stream, ts, event_id, case when event_type = 'signup' and value < 1 then event_id::varchar end marker, event_type from events),
placed as (select *, last_value(marker ignore nulls) over w context, count(marker) over w episode from marked window w as (partition by stream order by ts, event_id rows between unbounded preceding and current row)),
run as (select *, sum((event_type = 'error')::int) over w invalid_nal, sum((event_type = 'view')::int) over w missing_picture, sum((event_type not in ('error', 'view'))::int) over w other, count(*) over w total,
  lead(event_id) over (partition by stream, episode order by ts, event_id) nxt from placed where marker is null window w as (partition by stream, episode order by ts, event_id rows between unbounded preceding and current row))"""

HASHED = f"hashed as (select distinct {identity('video_path')} video, frame_index, {bits('phash')} bits from frames where {identity('video_path')} is not null and frame_index is not null and {bits('phash')} is not null)"

SQL: dict[str, str] = {}


def natural(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower(coalesce({c}, '')), '([0-9]+)', '0000000000000000000\\1', 'g'), '[0-9]*([0-9]{{20}})', '\\1', 'g')"


def escaped(c: str) -> str:
    out = f"coalesce({c}, '')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


LABEL = """case relation when 'near_duplicate_or_same_content' then 'Near duplicate' when 'B_is_likely_clip_of_A' then 'B is a clip of A' when 'A_is_likely_clip_of_B' then 'A is a clip of B' when 'partial_overlap' then 'Partial overlap' when 'similar' then 'Similar'
  when 'different' then 'Different' when 'identical' then 'Identical' when 'identical_file' then 'Identical file' when 'a_contains_b' then 'A contains B' when 'b_contains_a' then 'B contains A' else relation end"""
RANK = """case when regexp_matches(lower(relation), 'identical') then 5 when regexp_matches(lower(relation), 'clip|contains') then 4 when contains(lower(relation), 'near') then 3 when contains(lower(relation), 'partial') then 2
  when contains(lower(relation), 'similar') then 1 when contains(lower(relation), 'different') then 0 else -1 end"""


def percent(c: str) -> str:
    return f"case when {c} is not null and not isnan({c}) then printf('%.1f', case when {c} <= 1 then {c} * 100 else {c} end) || '%' else '-' end"


SQL["p4_found"] = """with i as (select pair_id, 'segment' track, a_start s, a_end e from report_segments
  union all select pair_id, direction, source_start, source_end from report_windows),
m as (select distinct pair_id, track, round(s * 1000)::bigint s, round(e * 1000)::bigint e from i where s is not null and e is not null and not isnan(s) and not isnan(e)),
o as (select *, max(e) over (partition by pair_id, track order by s, e rows between unbounded preceding and 1 preceding) reach from m where e > s),
n as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by pair_id, track order by s, e rows unbounded preceding) isle from o),
p as (select pair_id, track, min(s) start_ms, max(e) end_ms from n group by pair_id, track, isle),
g as (select pair_id, track, lag(end_ms) over (partition by pair_id, track order by start_ms) start_ms, start_ms end_ms from p)
select pair_id, track, 'period' kind, start_ms, end_ms from p union all select pair_id, track, 'gap', start_ms, end_ms from g where start_ms is not null"""

ALL_CLIPS = "cands as (select x.video_id a, y.video_id b from (select distinct video_id from frames_) x join (select distinct video_id from frames_) y on x.video_id < y.video_id)"


def containment(pairs: str, counts: str = CLIP_COUNTS) -> str:
    """Tables up to ``full_``: coverage, counts and durations of each of ``cands``."""
    return f"""{CLIPS}, {pairs}, {clip_matches("cands", counts)}, {fold("a, b, direction", "matches")}, {coverage("a, b, direction")},
joined as (select p.a, p.b, coalesce(max(coverage) filter (where direction = 'A_to_B'), 0.0) a_in_b, coalesce(max(coverage) filter (where direction = 'B_to_A'), 0.0) b_in_a
  from cands p left join covered c on c.a = p.a and c.b = p.b group by p.a, p.b),
full_ as (select j.*, x.n total_frames_a, y.n total_frames_b, x.d duration_a, y.d duration_b from joined j join counts x on x.video_id = a join counts y on y.video_id = b)"""


LABELLED = f"select a, b, round(a_in_b, 6) a_in_b, round(b_in_a, 6) b_in_a, round((a_in_b + b_in_a) / 2, 6) symmetric_similarity, total_frames_a, total_frames_b, duration_a, duration_b, {ENGINE} relation"
SQL["containment_relation"] = f"with recursive {containment(candidates(3))} {LABELLED} from full_"
SQL["containment_all_pairs"] = f"with recursive {containment(ALL_CLIPS)} {LABELLED} from full_"
SQL["analysis_pairs"] = f"""with recursive {containment(candidates(3), STATED)}, means as (select a, b, avg(sim) filter (where direction = 'A_to_B' and sim >= 0.65) ma, avg(sim) filter (where direction = 'B_to_A' and sim >= 0.65) mb from sims where rank = 1 group by 1, 2)
{LABELLED}, round(coalesce(ma, 0), 6) avg_similarity_a_to_b, round(coalesce(mb, 0), 6) avg_similarity_b_to_a from full_ left join means using (a, b)"""
SQL["analysis_segments"] = f"""with recursive {CLIPS}, {candidates(3)}, {clip_matches("cands")}, {fold("a, b", "matches")}, x as (select *, {SEGMENT} from clusters where n >= 3 and se - ss >= 5),
y as (select *, row_number() over (partition by a, b, least((ss, se), (ts, te)), greatest((ss, se), (ts, te)) order by round(confidence, 9) desc, cluster) rn from x)
select a, b, round(ss, 6) source_start, round(se, 6) source_end, round(ts, 6) target_start, round(te, 6) target_end, round(confidence, 6) confidence, n match_count from y where rn = 1"""
SQL["analysis_windows"] = f"""with {CLIPS}, {candidates(3)}, {clip_matches("cands")},
w as (select a, b, direction, min(src_ts) f, case when max(src_ts) <= min(src_ts) then min(src_ts) + 30 else max(src_ts) end l from matches group by 1, 2, 3),
spine as (select a, b, direction, f, unnest(range(ceil((l - f) / 30)::bigint)) k from w),
st as (select m.a, m.b, m.direction, floor((src_ts - f) / 30)::bigint k, count(*) n, avg(sim) s, min(tgt_ts) lo, max(tgt_ts) hi from matches m join w using (a, b, direction) group by 1, 2, 3, 4)
select s.a, s.b, s.direction, s.k as "window", round(f + s.k * 30, 6) source_start, round(f + s.k * 30 + 30, 6) source_end, coalesce(n, 0) matched_frame_count, round(least(1.0, coalesce(n, 0) / 30), 6) matched_frame_ratio,
  round(coalesce(t.s, 0), 6) avg_similarity, round(coalesce(lo, 0), 6) best_target_start, round(coalesce(hi, 0), 6) best_target_end from spine s left join st t on t.a = s.a and t.b = s.b and t.direction = s.direction and t.k = s.k"""

SQL["topk_similarity_join"] = f"with {LABELS}, {sims(3)} select a, b, direction, src, tgt, sim, rank from sims where sim >= 0.25"
SQL["bidirectional_matches"] = f"with {LABELS}, {sims(3)} select a, b, count(*) filter (where direction = 'A_to_B') matches_a_to_b, count(*) filter (where direction = 'B_to_A') matches_b_to_a from sims where sim >= 0.25 group by a, b"
SQL["best_match_stats"] = f"with {LABELS}, {sims(1)} select a, b, direction, count(*) filter (where sim >= 0.3) matched_frames, round(coalesce(avg(sim) filter (where sim >= 0.3), 0), 6) avg_similarity from sims group by a, b, direction"
SQL["raw_similarity_stats"] = f"with {LABELS}, {sims(1)}, b as (select a, b, greatest(sim, 0.0) s from sims) select a, b, round(max(s), 6) raw_max, round(avg(s) + 1e-9, 6) raw_mean, round(quantile_cont(s, 0.95), 6) raw_p95, round(quantile_cont(s, 0.99), 6) raw_p99 from b group by a, b"
SQL["raw_stats_early_stop"] = f"""with {LABELS}, {sims(1)}, n as (select video_id, count(*) n from frames_ group by 1), b as (select a, b, direction, greatest(sim, 0.0) s from sims),
f as (select b.*, direction = (case when x.n <= y.n then 'A_to_B' else 'B_to_A' end) lead_ from b join n x on x.video_id = a join n y on y.video_id = b),
st as (select a, b, max(s) < {EARLY_THRESHOLD} and quantile_cont(s, 0.99) < {EARLY_THRESHOLD} - 0.04 stopped from f where lead_ group by 1, 2)
select a, b, round(max(s), 6) raw_max, round(avg(s) + 1e-9, 6) raw_mean, round(quantile_cont(s, 0.95), 6) raw_p95, round(quantile_cont(s, 0.99), 6) raw_p99 from f join st using (a, b) where lead_ or not stopped group by a, b"""
SQL["video_search_topk"] = """select "query", rank::int as rank, vec_id, similarity from (select *, row_number() over (partition by "query" order by similarity desc, vec_id) as rank from (
  select q.vec_id "query", e.vec_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) similarity from embeddings q join embeddings e on q.vec_id % 100 = 0)) where rank <= 10"""
SQL["embedding_stats"] = "with n as (select len(embedding) d, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) n from embeddings where len(embedding) > 0) select count(*) num_embeddings, max(d) embedding_dim, round(avg(n), 6) mean_norm, round(stddev_pop(n), 6) std_norm, round(min(n), 6) min_norm, round(max(n), 6) max_norm from n"
SQL["video_diversity"] = f"with {LABELS} select x.video_id, any_value(c.n) n, round(avg(list_cosine_similarity(x.e, y.e)), 6) mean_similarity from frames_ x join frames_ y on x.video_id = y.video_id and x.pos <> y.pos join (select video_id, count(*) n from frames_ group by 1) c on c.video_id = x.video_id group by x.video_id"
SQL["video_vectors"] = """with c as (select label video_id, unnest(range(64)) dim, unnest(embedding::double[]) x from embeddings), m as (select video_id, dim, avg(x) m from c group by 1, 2)
select video_id, dim::int dim, round(m / sqrt(sum(m * m) over (partition by video_id)), 6) x from m"""
SQL["all_pairs"] = f"with {CLIPS}, v as (select distinct video_id from frames_) select x.video_id a, y.video_id b from v x join v y on x.video_id < y.video_id"

SQL["candidate_pairs"] = f"with {CLIPS}, {candidates(3)} select a, b from cands"
SQL["candidate_pairs_default"] = f"with {CLIPS}, {candidates(20)} select a, b from cands"
SQL["candidate_pairs_forest"] = SQL["candidate_pairs"]

SQL["representative_positions"] = f"""with n as (select {identity("video_path")} video_id, count(distinct frame_id) n from frames where {identity("video_path")} is not null group by 1)
select distinct video_id, (case when c > 1 then floor(i * (n - 1) / (c - 1)) else 0 end)::bigint pos from (select video_id, n, least(16, n) c, unnest(range(least(16, n))) i from n)"""

SQL["phash_steps"] = f"""with f as (select frame_id, max({identity("video_path")}) v, max(frame_index) frame_index, max({bits("phash")}) h from frames group by 1),
p as (select frame_id, h, lag(h) over (partition by v order by frame_index, frame_id) b from f where v is not null and h is not null)
select frame_id, 1 - bit_count(xor(h, b)) / 64.0::double similarity from p where b is not null"""

SQL["temporal_coverage"] = f"with recursive {MATCHES}, {fold('pair_id, direction', 'matches')}, {coverage('pair_id, direction')} select pair_id, direction, round(coverage, 6) coverage from covered"
SQL["offset_clusters"] = f"with recursive {MATCHES}, {fold('pair_id, direction', 'matches')} select match_id, cluster from clustered"
SQL["matched_segments"] = f"""with recursive {MATCHES}, {fold("pair_id, direction", "matches")}, x as (select *, {SEGMENT} from clusters where n >= 3 and se - ss >= 5)
select pair_id, direction, round(ss, 6) source_start, round(se, 6) source_end, round(ts, 6) target_start, round(te, 6) target_end, round(duration, 6) duration, round(coverage, 6) coverage, round(s, 9) avg_similarity, round(confidence, 9) confidence, n match_count from x"""
SQL["segments_dedup"] = f"""with recursive {MATCHES}, {fold("pair_id", "matches")}, x as (select *, {SEGMENT} from clusters where n >= 3 and se - ss >= 5),
y as (select *, row_number() over (partition by pair_id, least((ss, se), (ts, te)), greatest((ss, se), (ts, te)) order by round(confidence, 9) desc, cluster) rn from x)
select pair_id, round(ss, 6) source_start, round(se, 6) source_end, round(ts, 6) target_start, round(te, 6) target_end, round(confidence, 9) confidence, n match_count from y where rn = 1"""

SQL["window_similarity"] = f"""with {MATCHES}, m as (select * from matches where src_ts is not null and not isnan(src_ts) and tgt_ts is not null),
b as (select pair_id, direction, min(src_ts) f, case when max(src_ts) <= min(src_ts) then min(src_ts) + 30 else max(src_ts) end l from m group by 1, 2),
spine as (select pair_id, direction, f, unnest(range(ceil((l - f) / 30)::bigint)) k from b),
st as (select m.pair_id, m.direction, floor((src_ts - f) / 30)::bigint k, count(*) n, avg(sim) s, min(tgt_ts) lo, max(tgt_ts) hi from m join b on m.pair_id = b.pair_id and m.direction = b.direction group by 1, 2, 3)
select s.pair_id, s.direction, s.k as "window", round(f + s.k * 30, 6) source_start, round(f + s.k * 30 + 30, 6) source_end, coalesce(n, 0) matched_frame_count, round(least(1.0, coalesce(n, 0) / 30), 6) matched_frame_ratio,
  round(coalesce(t.s, 0), 9) avg_similarity, round(coalesce(lo, 0), 6) best_target_start, round(coalesce(hi, 0), 6) best_target_end from spine s left join st t on t.pair_id = s.pair_id and t.direction = s.direction and t.k = s.k"""

SQL["dynamic_sampling"] = f"""with recursive {HASHED}, f as materialized (select *, row_number() over (partition by video order by frame_index, bits) rn from hashed),
w as (select video, frame_index, bits, rn, true kept, frame_index li, bits lb from f where rn = 1 union all
  select f.video, f.frame_index, f.bits, f.rn, k, case when k then f.frame_index else li end, case when k then f.bits else lb end
  from (select w.video wv, w.rn wr, li, lb from w) w join f on f.video = wv and f.rn = wr + 1, lateral (select f.frame_index - li >= 40 or 1 - bit_count(xor(f.bits, lb)) / 64.0 < 0.60 k))
select video, frame_index, bits from w where kept"""
SQL["stream_sampler"] = SQL["dynamic_sampling"]
SQL["frame_step_filter"] = "select distinct frame_id, frame_index from frames where frame_index % 6 = 0"

DUPES = "g as (select text, octet_length(encode(text)) size, count(distinct doc_id) members, min(doc_id) as first from documents where text is not null and text <> '' group by text having count(distinct doc_id) > 1)"
SQL["duplicate_groups"] = f"with {DUPES} select members, first, size * (members - 1) redundant_bytes from g"
SQL["duplicate_pairs"] = f"with {DUPES} select x.doc_id a, y.doc_id b, 'identical_file' relation, 1.0::double symmetric_similarity from g join documents x using (text) join documents y using (text) where x.doc_id < y.doc_id and (members <= 200 or x.doc_id = first)"
SQL["redundant_copies"] = f"with {DUPES} select distinct doc_id from documents join g using (text) where doc_id > first"

SQL["scan_filter"] = f"""with {VIDEOS} select scan_id, name, size_bytes from v where size_bytes between 20 * 1048576 and 600 * 1048576
  and (contains(lower(name), 'bridge') or contains(lower(name), 'tram') or contains(lower(name), 'lantern')) and lower(regexp_replace(extension, '^\\.', '')) in ('mp4', 'mkv', 'mov')"""
SQL["metadata_filter"] = f"with {VIDEOS}, {DURATIONS} select scan_id from v where {norm_path('path')} in (select path from lens where duration between 120 and 240)"
SQL["metadata_join"] = f"with {VIDEOS}, {DURATIONS} select scan_id, round(duration, 3) duration, duration is not null readable from v left join lens on lens.path = {norm_path('v.path')}"
SQL["scan_sort"] = f"with {VIDEOS} select scan_id, size_bytes, row_number() over (order by size_bytes desc, {natural('name')}, {natural('path')}, scan_id) place from v where size_bytes is not null"
SQL["scan_sort_metadata"] = f"""with {VIDEOS}, {DURATIONS} select scan_id, row_number() over (order by duration is not null desc, duration nulls first, {natural('name')}, {natural('v.path')}, scan_id) place from v left join lens on lens.path = {norm_path('v.path')}"""
SQL["explicit_scan"] = f"""with {VIDEOS}, w as (select {norm_path('video_a_path')} p from report_pairs where trim(video_a_path) <> '') select distinct {norm_path('path')} path from v where {norm_path('path')} in (select p from w)
  and not ({norm_path('path')} = '/srv/video/archive' or starts_with({norm_path('path')}, '/srv/video/archive/'))"""
ENDS = f"""ends as (select {norm_path('path')} path, {{0}} from v where path is not null group by 1)"""
SQL["inputs_changed"] = f"""with {VIDEOS}, k as (select {norm_path('path')} p, * from v where path is not null), o as (select distinct p, arg_min({{'s': size_bytes, 'm': modified_at_ms}}, scan_id) x from k group by p), n as (select distinct p, arg_max({{'s': size_bytes, 'm': modified_at_ms}}, scan_id) x from k group by p),
j as (select o.p op, n.p np from o full join n on o.p = n.p and o.x.s = n.x.s and o.x.m = n.x.m) select count(*) filter (where op is null) added, count(*) filter (where np is null) removed, count(*) filter (where op is null or np is null) > 0 and count(op) > 0 changed from j"""
SQL["fresh_scans"] = f"""with {VIDEOS}, e as (select {norm_path('path')} path, arg_min({{'s': size_mb, 'x': extension, 'm': modified_at_ms}}, scan_id) o, arg_max({{'s': size_mb, 'x': extension, 'm': modified_at_ms}}, scan_id) n from v where path is not null group by 1)
select path, (o.s is not distinct from n.s or coalesce(abs(o.s - n.s) <= 1e-6, false)) and o.x is not distinct from n.x and o.m is not distinct from n.m fresh from e"""
SQL["scan_summary"] = f"with {VIDEOS} select count(*) videos, round(sum(size_mb), 2) total_mb from v where not isnan(size_mb)"
SQL["cache_inventory"] = f"""with {VIDEOS}, x as (select lower(extension) category, string_split({norm_path("path")}, '/')[1] || coalesce('/' || string_split({norm_path("path")}, '/')[2], '') as name, size_bytes from v),
y as (select category, case when name is null then null else name end as name, size_bytes from x)
select category, name, sum(size_bytes)::bigint size_bytes, count(*) entries, grouping(category, name)::int as level from y group by rollup (category, name)"""
SQL["report_catalogue"] = """with f as (select 'r' || o_custkey report_key, case o_orderstatus when 'F' then 'json' when 'O' then 'csv' else 'html' end ext, floor(o_totalprice)::bigint s, epoch_ms(o_orderdate) t from orders)
select report_key, sum(s)::bigint size_bytes, max(t) modified_ms, string_agg(distinct ext, '+' order by ext) formats,
  '/reports/' || report_key || '.' || (case when bool_or(ext = 'json') then 'json' when bool_or(ext = 'csv') then 'csv' else 'html' end) path from f group by report_key"""

SQL["stream_validation"] = """with k as (select user_id video, row_number() over (partition by user_id order by ts, event_id) n, case when event_type = 'purchase' and value > 150 then 'f' when event_type = 'error' then 's' when event_type = 'view' then 'm' end kind from events),
r as (select *, sum((kind = 's')::int) over w s, sum((kind = 'm')::int) over w m from k window w as (partition by video order by n rows between unbounded preceding and current row)),
e as (select video, min(n) filter (where kind = 'f' or s >= 20 or m >= 12) stop from r group by video),
x as (select r.video, coalesce(max(s), 0)::bigint severe, coalesce(max(m), 0)::bigint missing, coalesce(max((n = stop and kind = 'f')::int), 0) fatal from r join e using (video) where stop is null or n <= stop group by r.video)
select video, severe, missing, case when fatal = 1 then 'moov atom not found' when severe >= 20 then '[h264 @ 1] Invalid NAL unit size (10 > 2).; ' || severe || ' severe stream errors' when missing >= 12 then missing || ' missing pictures' end verdict from x"""
SQL["line_router"] = f"""with {LINES}, p as (select *, string_split(line, '|') f from lines), r as (select case when starts_with(line, 'ANALYSIS_VIDEO_CONTEXT|') then 'context' when contains(line, '[h264 @') then 'warning' when starts_with(line, 'ANALYSIS_VIDEO_QUARANTINED|') then 'quarantine'
  when starts_with(line, 'PROGRESS|') and trim(f[2]) in ('scan', 'model', 'index', 'candidate', 'compare', 'report', 'done') and try_cast(trim(f[3]) as double) is not null and try_cast(trim(f[4]) as double) is not null then 'progress' when {HIDDEN} then 'hidden' else 'log' end route from p)
select route, count(*) lines from r group by 1"""
SQL["log_filter"] = f"with {LINES} select video, count(*) filter (where {HIDDEN}) hidden, count(*) filter (where {IMPORTANT}) important, count(*) filter (where {has('lower(line)', ('cannot open video', 'decoded no usable frames', 'no frames retained', 'error splitting the input', 'invalid nal unit', 'failed to decode', 'unable to decode', 'decord'))}) decode_failures from lines group by video"
SQL["log_warning_summaries"] = f"""with {WARNINGS} select stream, episode, context, 'running' kind, invalid_nal, missing_picture, other, total from run where total = 100 or total % 1000 = 0
union all select stream, episode, context, 'final', invalid_nal, missing_picture, other, total from run where nxt is null and not (total = 100 or total % 1000 = 0) and (total >= 100 or invalid_nal + other >= 20)"""
SQL["monotone_progress"] = "with m as (select event_id, max(least(greatest(value, 0.0), 100.0)) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) t from events) select event_id, case when t < 100 then least(t, 99.99) else t end shown from m"
SQL["log_tail"] = "select event_id from (select event_id, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn <= 20"

SQL["task_stages"] = """with g as (select user_id task, ['scan', 'cache', 'features', 'candidate'][(event_id % 4 + 1)::int] id, case when event_type in ('purchase', 'click') then 'completed' when event_type = 'view' then 'running' else 'failed' end status, value, ts, event_id from events),
s as (select task, id, arg_max(status, (ts, event_id)) status, arg_max(value, (ts, event_id)) progress from g group by 1, 2),
b as (select * from (values (0, 'scan', 12.0), (1, 'cache', 8.0), (2, 'features', 35.0), (3, 'candidate', 8.0), (4, 'compare', 30.0), (5, 'report', 7.0)) t(idx, id, w)),
m as (select t.task, b.idx, b.id, b.w::double w, coalesce(s.status, 'pending') status, least(100.0, greatest(0.0, coalesce(s.progress, 0.0))) progress from (select distinct task from s) t cross join b left join s on s.task = t.task and s.id = b.id)
select task, round(sum(w * progress) / sum(w), 2) progress, arg_min(id, idx) filter (where status <> 'completed') next_stage, coalesce(string_agg(id, ',' order by idx) filter (where status <> 'completed' and idx < 4), '') blocking from m group by task"""
SQL["elapsed_stages"] = "select o_custkey, sum(floor(o_totalprice)::bigint + case when o_orderstatus = 'O' then greatest(0, 893000000000 - epoch_ms(o_orderdate)) else 0 end)::bigint elapsed_ms from orders group by 1"
SQL["merged_reports"] = """with r as (select 'c' || o_custkey report_key, case when o_orderstatus = 'F' then '/r/' || o_orderkey || '.json' end json_path, case when o_orderstatus in ('F', 'O') then '/r/' || o_orderkey || '.csv' end csv_path, epoch_ms(o_orderdate) modified_ms from orders)
select report_key, json_path, csv_path, modified_ms from (select *, row_number() over (partition by report_key order by modified_ms desc, json_path desc nulls last, csv_path desc nulls last) rn from r where coalesce(json_path, csv_path) is not null) where rn = 1"""
SQL["weighted_progress"] = "with s as (select o_custkey, o_totalprice w, case o_orderstatus when 'F' then 100.0 when 'O' then 0.0 else 55.5 end p from orders) select o_custkey, round(sum(w::double * p::double) / sum(w), 2) progress from s group by 1"
SQL["stage_replay"] = """with e as (select user_id task, ts, event_id, epoch_us(ts) // 1000 at_ms, case event_type when 'view' then 'running' when 'click' then 'paused' when 'purchase' then 'completed' when 'error' then 'failed' else 'pending' end status, value from events),
b as (select *, coalesce(lag(status) over w, 'pending') before from e window w as (partition by task order by ts, event_id)),
s as (select *, last_value(case when status = 'running' and before <> 'running' then at_ms end ignore nulls) over (partition by task order by ts, event_id rows between unbounded preceding and current row) since from b)
select task, 'compare' stage, arg_max(status, (ts, event_id)) status, arg_max(case when status = 'completed' then 100.0 else round(least(100.0, greatest(0.0, value)), 2) end, (ts, event_id)) progress,
  sum(case when status in ('paused', 'completed', 'failed') and before = 'running' then greatest(0, at_ms - since) else 0 end)::bigint elapsed_ms from s group by task"""
SQL["smallest_unused"] = "with u as (select distinct o_custkey, o_orderkey % 7 + 1 n from orders), g as (select c.o_custkey, g.n from (select distinct o_custkey from u) c, range(1, 9) g(n)) select g.o_custkey, min(g.n) unused from g left join u on u.o_custkey = g.o_custkey and u.n = g.n where u.n is null group by 1"

KEYED = f"p as (select *, least(x, y) || '||' || greatest(x, y) pair_key from (select {norm_path('video_a_path')} x, {norm_path('video_b_path')} y, config_id, pair_id, completed_at, video_a_path, video_b_path from report_pairs))"
SQL["resume_pending"] = f"with {KEYED} select distinct pair_key from p where config_id = 3 and pair_key not in (select pair_key from p where config_id <> 3)"
SQL["store_upsert"] = f"with {KEYED} select pair_key, arg_max(pair_id, (completed_at, pair_id)) pair_id from p where completed_at is not null group by 1"

SQL["report_normalise"] = f"with {NORMAL} select pair_id, pair_key, video_a, video_b, round(a_in_b, 6) a_in_b, round(b_in_a, 6) b_in_a, round(symmetric_similarity, 6) symmetric_similarity, relation, total_frames_a::bigint total_frames_a, segs matched_segment_count from normal"
COMPLETE = "segs * 8 + ma + mb + (symmetric_similarity is not null)::int + (a_in_b is not null)::int + (b_in_a is not null)::int"
SQL["report_dedupe"] = f"with {NORMAL} select pair_key, arg_max(pair_id, ({COMPLETE}, -pair_id)) pair_id, max({COMPLETE}) completeness from normal group by pair_key"
SQL["report_summary"] = f"""with {NORMAL}, vs as (select coalesce(nullif(x, ''), nullif(video_a, '')) v from normal union select coalesce(nullif(y, ''), nullif(video_b, '')) from normal)
select count(*) pairs, count(*) filter (where coalesce(symmetric_similarity, greatest(coalesce(a_in_b, 0), coalesce(b_in_a, 0))) >= 0.65) high_pairs, count(*) filter (where regexp_matches(lower(relation), 'partial|clip|contain|重叠|包含')) partial_pairs, sum(segs)::bigint segments, (select count(v) from vs) videos from normal"""
SQL["relation_histogram"] = f"with {NORMAL} select relation, count(*) pairs from normal group by 1"
SQL["relation_counters"] = f"with {NORMAL}, l as (select lower(relation) r from normal) select count(*) filter (where contains(r, 'near')) near, count(*) filter (where contains(r, 'clip')) clip, count(*) filter (where contains(r, 'partial')) as \"partial\", count(*) filter (where r = 'different') different from l"
SQL["report_filter"] = f"with {NORMAL} select pair_id, relation, round(symmetric_similarity, 6) symmetric_similarity from normal where regexp_matches(lower(relation), 'clip|片段') and symmetric_similarity >= 0.3 and contains(lower(concat_ws(' ', video_a, video_b, regexp_extract(replace(x, '\\', '/'), '[^/]*$'), regexp_extract(replace(y, '\\', '/'), '[^/]*$'))), 'tram')"
SQL["report_classes"] = f"""with {NORMAL}, k as (select * from (values ('all', '.*'), ('near', '(?i)near|identical|重复'), ('partial', '(?i)partial|contains|重叠|包含'), ('clip', '(?i)clip|片段'), ('unknown', '(?i)^unknown$|未知'), ('different', '(?i)different|差异')) t(kind, rule))
select kind, count(*) filter (where regexp_matches(relation, rule)) pairs from normal cross join k group by kind"""
SORTS = {"completed_at": "completed_at", "video_a": natural("video_a"), "video_b": natural("video_b"), "a_in_b": "a_in_b", "b_in_a": "b_in_a", "symmetric_similarity": "symmetric_similarity", "matched_segment_count": "segs", "frame_matches": "ma + mb", "relation": f"{RANK} desc nulls last, {natural(LABEL)}"}
SQL["report_sorts"] = f"with {NORMAL} " + " union all ".join(f"select '{k}' sort_key, pair_id, row_number() over (order by {e} desc nulls last, pair_id) place from normal" for k, e in SORTS.items())
SQL["html_rows"] = f"with {NORMAL} select '<tr><td>' || {escaped('video_a')} || '</td><td>' || {escaped('video_b')} || '</td><td>' || {percent('a_in_b')} || '</td><td>' || {percent('b_in_a')} || '</td><td>' || {percent('symmetric_similarity')} || '</td><td>' || {escaped(LABEL)} || '</td></tr>' html from normal"
SQL["report_page"] = f"with {NORMAL} select pair_id, round(symmetric_similarity, 6) symmetric_similarity from normal order by symmetric_similarity desc nulls last, pair_id limit 25 offset 50"
SQL["video_entries"] = f"with {NORMAL} select pair_key, 'A' side, video_a video, x path from normal union all select pair_key, 'B', video_b, y from normal"
SQL["delete_pairs"] = f"with {NORMAL}, {KEYED} select pair_id from normal where pair_key not in (select pair_key from p where config_id = 8 and video_a_path is not null and video_b_path is not null)"
SQL["match_orientation"] = f"""with m as (select *, {ratio("similarity")} s from frame_matches where not isnan(similarity)) select distinct match_id, direction, case when direction = 'A_to_B' then source_frame_index else target_frame_index end frame_a,
  case when direction = 'A_to_B' then target_frame_index else source_frame_index end frame_b, case when direction = 'A_to_B' then source_timestamp else target_timestamp end ts_a, round(s, 6) similarity from m where s >= 0.6"""
SQL["top240_matches"] = f"""with m as (select distinct match_id, pair_id, direction, {ratio("similarity")} s from frame_matches where not isnan(similarity))
select match_id, rank::int as rank, total from (select match_id, row_number() over (partition by pair_id, direction order by s desc nulls last, match_id) as rank, count(*) over (partition by pair_id, direction) total from m) where rank <= 240"""
SQL["dedupe_windows"] = "select direction, count(*) windows from (select distinct pair_id, direction, source_start, source_end from report_windows where not isnan(source_start) and not isnan(source_end)) group by 1"

SQL["timeline_intervals"] = f"""with {EVENT_CLIPS}, pts as (select composition, s pt from clips union select composition, e from clips), sp as (select *, lead(pt) over (partition by composition order by pt) nxt from pts)
select sp.composition, pt as start, nxt as "end", string_agg(clip::varchar, ',' order by track, clip) active from sp join clips c on c.composition = sp.composition and s <= (pt + nxt) / 2 and (pt + nxt) / 2 < e where nxt - pt > 0.000001 group by 1, 2, 3"""
SQL["total_duration"] = f"with {EVENT_CLIPS} select max(e)::double duration from clips"
SQL["active_at"] = f"with {EVENT_CLIPS} select track, clip, s as start from clips where s <= 2500.5 and 2500.5 < e"
SQL["points_in_clips"] = f"with {EVENT_CLIPS} select p.clip point, c.clip from clips p join clips c on c.composition = p.composition and c.track = p.track and c.s <= p.s + 0.5 and p.s + 0.5 < c.e"
SQL["sequential_track_cursor"] = f"""with recursive {EVENT_CLIPS}, n as materialized (select *, row_number() over (partition by composition order by clip) rn, e - s d, case when o_orderpriority = '1-URGENT' then s end want from clips),
w as (select composition, clip, rn, greatest(0.0, coalesce(want, 0.0)) st, d, greatest(0.0, greatest(0.0, coalesce(want, 0.0)) + d) cur from n where rn = 1 union all
  select n.composition, n.clip, n.rn, (case when n.want is null then w.cur else greatest(0.0, n.want) end), n.d, greatest(w.cur, (case when n.want is null then w.cur else greatest(0.0, n.want) end) + n.d) from w join n on n.composition = w.composition and n.rn = w.rn + 1)
select composition track, clip, st::double as start, (st + d)::double as "end" from w"""
SQL["track_neighbours"] = f"with {EVENT_CLIPS} select clip, lag(clip) over (partition by composition order by s, clip) previous, lead(clip) over (partition by composition order by s, clip) as \"next\" from clips"
SQL["grid_cells"] = """with c as (select o_orderkey clip, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int i, (count(*) over (partition by o_custkey))::int n from orders),
g as (select *, case when n <= 4 then 2 else 3 end cols from c), r as (select *, (n + cols - 1) // cols rws from g),
z as (select clip, i, cols, case when n <= 1 then 1920 else greatest(2, (1920 // cols) - (1920 // cols) % 2) end w, case when n <= 1 then 1080 else greatest(2, (1080 // rws) - (1080 // rws) % 2) end h from r)
select clip, ((i % cols) * w)::int x, ((i // cols) * h)::int y, w::int cell_width, h::int cell_height from z"""

ONE_PAIR = "one as (select pair_id, any_value(a_in_b) a, any_value(b_in_a) b, any_value(symmetric_similarity) s from report_pairs group by 1)"
SQL["ratio_normalise"] = f"""with {ONE_PAIR} select pair_id, {ratio("a")} a_in_b, case when b is not null and not isnan(b) then printf('%.1f', case when b <= 1 then b * 100 else b end) || '%' else '-' end b_in_a,
  case when s is not null and not isnan(s) then printf('%.2f', case when s > 1 then s / 100 else s end) else '-' end score from one"""
SQL["path_normalise"] = f"select distinct scan_id, {norm_path('video_path')} path, regexp_extract({norm_path('video_path')}, '[^/]*$') base from videos where video_path is not null"
BASE = "regexp_extract(replace({0}, '\\', '/'), '[^/]*$')"
SQL["text_functions"] = f"""with v as (select distinct scan_id, video_name n, video_path p, modified_at_ms m from videos where video_name is not null and video_path is not null)
select scan_id, coalesce(nullif(regexp_replace(regexp_replace(n, '[^\\p{{L}}\\p{{N}}._-]', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'video') safe, regexp_matches(regexp_replace({BASE.format('n')}, '(.)\\.[^.]*$', '\\1'), '^[A-Za-z0-9_-]+$') safe_id, lower(regexp_extract({BASE.format('p')}, '.\\.([^.]+)$', 1)) ext,
  regexp_replace({BASE.format('p')}, '(.)\\.[^.]*$', '\\1') stem, regexp_replace(n, '\\.[^./\\\\]*$', '') || '.srt' sibling, '"' || replace(n || ',"x"', '"', '""') || '"' csv, {escaped("n || '<&''" + '">' + "'")} html, regexp_replace(n || 'a:b,' || chr(39) || '5%' || chr(39), '([\\\\:'',%])', '\\\\\\1', 'g') drawtext,
  substr(trim(regexp_replace(concat_ws('  ', n, n, n, n, n, n, n, n), '\\s+', ' ', 'g')), 1, 160) error, regexp_replace(replace(n || '|x', '|', '｜'), '[\\r\\n]+', ' ', 'g') progress, substr(sha256(n), 1, 20) hash, {natural('n')} "natural", (case when m > 10000000000 then m else m * 1000 end)::bigint "at",
  case when regexp_matches(lower(n), 'identical') then 'strong' else 'clip' end tone, coalesce(nullif(trim(n), ''), '') said from v"""
SQL["timecode_format"] = """with f as (select frame_id, max(ts) ts from frames group by 1), n as (select *, greatest(0, floor(ts))::bigint n from f)
select frame_id, case when ts is null or isnan(ts) then '-' else lpad((n // 3600)::varchar, greatest(2, length((n // 3600)::varchar))::int, '0') || ':' || lpad((n % 3600 // 60)::varchar, 2, '0') || ':' || lpad((n % 60)::varchar, 2, '0') end hhmmss,
  case when ts is null then null when n >= 3600 then lpad((n // 3600)::varchar, greatest(2, length((n // 3600)::varchar))::int, '0') || ':' || lpad((n % 3600 // 60)::varchar, 2, '0') || ':' || lpad((n % 60)::varchar, 2, '0') else lpad((n // 60)::varchar, 2, '0') || ':' || lpad((n % 60)::varchar, 2, '0') end clock from n"""
SQL["size_format"] = """with x as (select distinct scan_id, size_bytes::double b from videos), y as (select *, case when b >= 1 then least(4, floor(log2(b) / 10 + 1e-12))::int end k from x)
select distinct scan_id, case when b >= 1 then regexp_replace(printf('%.2f', b / pow(1024.0, k)), '\\.?0+$', '') || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][k + 1] else '0 B' end size from y"""
F4 = "replace(regexp_replace(printf('%.4f', {0}::double), '\\.?0+$', ''), '.', 'p')"
SQL["profile_key"] = f"select config_id, preset_name || '__skip_' || {F4.format('skip_threshold')} || '__gap_' || {F4.format('max_gap_sec')} || 's__step_' || frame_step profile from analysis_config"
SQL["progress_parse"] = """with x as (select event_id, event_type, event_id % 5 k, least(1.0, greatest(0.0, floor(value) / 500)) r from events)
select event_id, event_type stage, round(case k when 0 then 5 + r * 7 when 1 then 20 + r * 35 when 2 then 63 + r * 27 else 90 + r * 8 end, 2) progress from x where k < 4"""
SQL["engine_relation"] = f"with {NORMAL} select pair_id, {ENGINE} engine, made report from normal where a_in_b is not null and b_in_a is not null"

SQL["diverse_frames"] = f"""with recursive {LABELS}, n as (select video_id, count(*) n from frames_ group by 1),
spots as (select distinct video_id, case when c > 1 then floor(i * (n - 1) / (c - 1)) else 0 end pos from (select video_id, n, least(64, n) c, unnest(range(least(64, n))) i from n)),
pool as materialized (select f.video_id, f.pos, e, row_number() over (partition by f.video_id order by f.pos) i from frames_ f join spots s on s.video_id = f.video_id and s.pos = f.pos),
near as materialized (select a.video_id, a.i, list(list_cosine_similarity(a.e, b.e) order by b.i) sims from pool a join pool b on a.video_id = b.video_id group by 1, 2),
w as (select video_id, 1 step, [1::bigint] picked, list_transform(sims, lambda x, j: case when j = 1 then 1e9 else x end) closest from near where i = 1 union all
  select w.video_id, step + 1, list_append(picked, r.i), list_transform(range(1, len(closest) + 1), lambda j: case when j = r.i then 1e9 else greatest(closest[j], r.sims[j]) end)
  from w join near r on r.video_id = w.video_id and r.i = list_position(closest, list_min(closest)) where step < least(16, len(closest)))
select p.video_id, p.pos frame_pos from w join pool p on p.video_id = w.video_id and list_contains(picked, p.i) where step = least(16, len(closest))"""


SPACE = r"[ \t\n\x0B\f\r\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def bare(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def cue_seconds(c: str) -> str:
    pattern = r"'^(?:([0-9]+):)?([0-9]{1,2}):([0-9]{1,2})(?:[.,]([0-9]{1,3}))?'"
    part = lambda k: f"coalesce(nullif(regexp_extract({bare(c)}, {pattern}, {k}), ''), '0')"
    return f"(case when regexp_matches({bare(c)}, {pattern}) then {part(1)}::int * 3600 + {part(2)}::int * 60 + {part(3)}::int + rpad({part(4)}, 3, '0')::double / 1000 end)"




def tidy(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: {bare('x')}), lambda x: x <> '')"


ENTITIES = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(said, '<[^>]+>', '', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g')"
SQL["subtitle_cues"] = rf"""with t as (select doc_id, regexp_replace(regexp_replace(ltrim(text, chr(65279)), '\r\n?', chr(10), 'g'), '(?i)^WEBVTT[^\n]*(\n|$)', '') body from documents where text is not null),
b as (select doc_id, unnest(range(len(l))) cue, unnest(l) block from (select doc_id, string_split_regex(body, '\n{{2,}}') l from t)),
c as (select doc_id, cue, {tidy("block")} l from b where contains(block, '-->')),
k as (select *, list_position(list_transform(l, lambda x: contains(x, '-->')), true) pos from c),
m as (select *, string_split(l[pos], '-->') parts, array_to_string(l[pos + 1:], chr(10)) said from k),
x as (select doc_id, cue, {cue_seconds("parts[1]")} as start, {cue_seconds(f"string_split_regex({bare('parts[2]')}, '{SPACE}+')[1]")} as "end", array_to_string({tidy(ENTITIES)}, chr(10)) as text from m)
select doc_id, cue::int cue, round(start, 3) as start, round("end", 3) as "end", text from x where "end" > start and text <> ''"""

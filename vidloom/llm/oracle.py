"""SQL for DuckDB that gives what the queries of this package give."""

from __future__ import annotations

IDENTITY = "lower(rtrim(replace(trim({0}), '\\', '/'), '/'))"


def _identity(c: str) -> str:
    x = IDENTITY.format(c)
    return f"(case when trim({x}) <> '' then {x} end)"


LINKS = f"""links as (select a, b from (select {_identity("video_a_path")} a, {_identity("video_b_path")} b from report_pairs
  where translate(lower(trim(relation)), '- ', '__') in ('identical', 'identical_file', 'near_duplicate_or_same_content')) where a <> b),
both_ways as (select a, b from links union select b, a from links),
reach as (select a v, a w from both_ways union select r.v, e.b from reach r join both_ways e on e.a = r.w),
grouped as (select v video_path, min(w) group_path from reach group by v)"""

P1_FOUND = f"with recursive {LINKS} select video_path, group_path from grouped"

P2_FOUND = f"""with recursive {LINKS},
sizes as (select m, arg_max(size_mb, (scanned_at, scan_id)) size from (select *, {_identity("video_path")} m from videos) where size_mb > 0 and not isnan(size_mb) group by m),
sides as (select pair_id, completed_at, {_identity("video_a_path")} m, duration_a d, total_frames_a n from report_pairs
  union all select pair_id, completed_at, {_identity("video_b_path")}, duration_b, total_frames_b from report_pairs),
durations as (select m, arg_max(d, (completed_at, pair_id)) d from sides where d > 0 and not isnan(d) group by m),
counts as (select m, arg_max(n, (completed_at, pair_id)) n from sides where n > 0 group by m)
select group_path, keeper_path from (select group_path, video_path keeper_path, row_number() over (partition by group_path
  order by coalesce(size, -1) desc, coalesce(d, -1) desc, coalesce(n, -1) desc, video_path) rn
  from grouped left join sizes s on s.m = video_path left join durations t on t.m = video_path left join counts c on c.m = video_path) where rn = 1"""

P6 = """with m as (select match_id, pair_id, direction, source_frame_index, max(target_frame_index) target_frame_index,
  round(case when similarity > 1 then similarity / 100 else similarity end, 4) similarity from frame_matches
  where source_frame_index is not null and similarity is not null and not isnan(similarity) group by match_id, pair_id, direction, source_frame_index, similarity),
p as (select pair_id, max(config_id) config_id from report_pairs group by pair_id),
r as (select m.*, candidate_limit, row_number() over (partition by m.pair_id, direction, source_frame_index
  order by similarity desc, target_frame_index nulls last, match_id) rn from m join p using (pair_id) join analysis_config using (config_id))
select {0} from r where rn <= candidate_limit"""

SIZED = "sized as (select doc_id, translate(lower(trim(source)), '- ', '__') source, coalesce(octet_length(encode(text)), 0) size from documents)"

P8_FOUND = f"""with {SIZED}, h as (select t.source, target_share, max_repeats, coalesce(sum(size), 0) have from mix_targets t left join sized using (source) group by all)
select source from h where have * max_repeats < target_share * (select sum(have) from h)"""

P9_FOUND = "select distinct doc_id from documents where octet_length(encode(text)) > (select tokens from size_limits where limit_name = 'piece_limit')"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND,
        "p2_found": P2_FOUND,
        "p6_found": P6.format("match_id"),
        "p6_top": P6.format("pair_id, direction, source_frame_index, rn::int as rank, match_id, target_frame_index, similarity"),
        "p8_found": P8_FOUND,
        "p9_found": P9_FOUND,
    }

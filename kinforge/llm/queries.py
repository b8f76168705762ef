"""Queries of the training-data operators, with the equivalent SQL where there is one."""

from kinforge.llm import copies, grouping, leakage, matching, packing, spam, spellings, survivors

_ALL = (
    copies.p1_found,
    copies.p1_records,
    spellings.p3_found,
    spellings.p3_spellings,
    survivors.p4_found,
    survivors.p4_facts,
    grouping.p5_found,
    grouping.p5_group_sizes,
    matching.p6_found,
    matching.p6_matches,
    packing.p7_packed,
    packing.p7_mixed,
    packing.p7_windows,
    leakage.p8_found,
    leakage.p8_matches,
    leakage.p8_items,
    spam.p9_found,
    spam.p9_pages,
)
QUERIES = {f.__name__: f for f in _ALL}

_GROUPS = """with recursive e as (select distinct indv_id_a x, indv_id_b y from candidates where indv_id_a <> '' and indv_id_b <> '' and indv_id_a <> indv_id_b),
 s as (select x, y from e union select y, x from e),
 r(node, root) using key (node) as (select x, min(least(x, y)) from s group by x
  union select s.y, min(r.root) from r join s on s.x = r.node join recurring.r o on o.node = s.y where r.root < o.root group by s.y)
 select root group_id, node indv_id from r"""

# p4: the fullest name, of equally full ones the last in the alphabet (p4_facts has what the model thinks of them)
_NAME = "regexp_replace(regexp_replace(regexp_replace(upper(mname), '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+$', ''), '\\s+', ' ', 'g')"
_ZIP = "regexp_replace(zipcode, '^[ ]+|[ ]+$', '', 'g')"
_SURVIVORS = f"""with x as (select distinct orig_id, ch_id from crosswalk where orig_id is not null and ch_id is not null),
 g as (select ch_id from x group by 1 having count(distinct orig_id) > 1),
 r as (select ch_id, received_at, idx, {_NAME} m, case when regexp_full_match({_ZIP}, '\\d{{5}}(-?\\d{{4}})?') and substr({_ZIP}, 1, 5) not in ({', '.join(f"'{str(d) * 5}'" for d in range(10))}) then substr({_ZIP}, 1, 5) end z
  from preprocess_file_template join x on orig_id = source_id semi join g using (ch_id)),
 n as (select *, case when regexp_matches(m, '\\p{{L}}') and m not in ({', '.join(f"'{p}'" for p in survivors.PLACEHOLDERS)}) then m end name from r)
 select ch_id, arg_max(name, (length(regexp_replace(name, '[^\\p{{L}}]', '', 'g')), name)) filter (name is not null) mname, arg_max(z, (received_at, idx)) filter (z is not null) zipcode from g left join n using (ch_id) group by 1"""

_WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower({}), '[\\p{{Cf}}\\x00-\\x08\\x0e-\\x1f\\x7f-\\x9f]', '', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda w: w <> '')"
_RUNS = "select {0}, hash(list_aggregate(w[i:i + 11], 'string_agg', ' ')) h from (select {0}, w, unnest(range(1, len(w) - 10)) i from (select {0}, {1} w from {2}))"
_LEAKS = f"select distinct doc_id, item_id from ({_RUNS.format('doc_id', _WORDS.format('text'), 'documents')}) join ({_RUNS.format('item_id', _WORDS.format('passage'), 'eval_items')}) using (h)"

SQL: dict[str, str] = {
    "p4_found": _SURVIVORS,
    "p8_found": _LEAKS,
    "p8_items": f"select item_id, cast(count(*) as bigint) n_pages from ({_LEAKS}) group by 1",
    "p5_found": _GROUPS,
    "p5_group_sizes": f"select size, cast(count(*) as bigint) n_groups from (select group_id, count(*) size from ({_GROUPS}) group by 1) group by 1",
}

"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm import block_naming, decontaminate, line_dedup, minhash_join, packing, quality_mil, suffix_array, suffix_tree, tagpath, toxicity
from quarrygraph.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("did", "th")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_mil.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", quality_mil.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_groups(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.jaccard_links(table(spark, sf_dir, "documents")).drop("did", "th", "root")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpath.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", quality_mil.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_line_dedup, op2_benchmark_decontamination, op3_quality_classifier, op4_exact_dedup, op5_ngram_jaccard_join, op6_best_fit_packing, op7_html_extraction, op8_substring_dedup, op9_toxicity, op10_suffix_array_dedup)
    return {f.__name__: f for f in all_}


#: Line dedup: lines by their keys; a key in five documents or more stays in the largest doc_id only.
_OP1 = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
parts as (select r, doc_id, string_split(text, chr(10)) as x from docs),
lines as (select r, doc_id, unnest(x) as line, unnest(range(len(x))) as i from parts),
keyed as (select r, doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
counted as (select k, max(doc_id) as keeper from keyed where length(k) >= 40 group by k having count(distinct r) >= 5),
marked as (select l.r, l.doc_id, l.i, l.line, c.k is not null and l.doc_id <> c.keeper as gone from keyed l left join counted c on l.k = c.k)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count_if(gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by r
"""

#: Exact dedup: texts without white space compared whole.
_OP4 = r"""
with d as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as k from documents),
g as (select k, count(*) as group_size, first(doc_id order by n desc, doc_id) as keep_id from d group by k)
select d.doc_id, g.keep_id, g.group_size::bigint as group_size, d.doc_id = g.keep_id as kept, sha256(d.k) as text_sha256
from d join g on d.k = g.k
"""

#: Substring dedup: every window of 35 words.
_OP8 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
starts as (select doc_id, unnest(range(1, greatest(len(ws) - 33, 1))) as p, ws from w),
keyed as (select doc_id, p, sha256(array_to_string(ws[p:p + 34], ' ')) as k from starts),
again as (select k from keyed group by k having count(*) > 1),
hit as (select doc_id, p from keyed semi join again using (k)),
gone as (select distinct doc_id, unnest(range(p, p + 35)) as i from hit),
word as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as i from w),
kept as (select word.doc_id, count(*) as n_words, count(gone.i) as n_removed, string_agg(word.x, ' ' order by word.i) filter (where gone.i is null) as t
  from word left join gone on word.doc_id = gone.doc_id and word.i = gone.i group by word.doc_id)
select w.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)
"""

#: Substring dedup over bytes: every window of 200, from blocks of 500 starts.
_OP10 = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
blocks as (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - 199, 0), 500)) as b from d),
pieces as (select doc_id, b, substring(h, 2 * b + 1, 1398) as x from blocks),
starts as (select doc_id, b, x, unnest(range(0, len(x) // 2 - 199)) as i from pieces),
keyed as (select doc_id, b + i as p, md5(substring(x, 2 * i + 1, 400)) as k from starts),
again as (select k from keyed group by k having count(*) > 1),
hit as (select doc_id, p from keyed semi join again using (k)),
marked as (select doc_id, p, coalesce(p > lag(p) over (partition by doc_id order by p) + 200, true) as opens from hit),
numbered as (select doc_id, p, sum(opens::int) over (partition by doc_id order by p) as r from marked),
gone as (select doc_id, r, min(p) as s, max(p) + 200 as e from numbered group by all),
cuts as (select doc_id, s, e from gone union all select doc_id, len(h) // 2, null from d),
kept as (select doc_id, coalesce(lag(e) over (partition by doc_id order by s, e nulls last), 0) as u, s as v, e from cuts)
select doc_id, (len(any_value(h)) // 2)::bigint as n_bytes, coalesce(sum(e - s), 0)::bigint as n_removed, count(e)::bigint as n_spans,
  sha256(unhex(string_agg(substring(h, 2 * u + 1, 2 * (v - u)), '' order by u, v))) as kept_sha256
from (select doc_id, u, v, e, v as s from kept) join d using (doc_id) group by doc_id
"""

#: Jaccard join: all pairs with a common 5-gram, and the components of those that reach 0.8.
_OP5 = r"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n, md5(string_agg(s, chr(31) order by s)) as whole from g group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as k from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by all),
link as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 5 * k >= 4 * (a.n + b.n - k)),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, y from reach join link on x = r),
class as (select doc_id, min(r) as class_id from reach group by doc_id),
copies as (select whole, min(doc_id) as copies_id, count(*) as n_copies from n group by whole)
select d.doc_id, class_id, (select count(*) from link where x = d.doc_id)::bigint as n_links, coalesce(copies_id, d.doc_id) as copies_id, coalesce(n_copies, 1)::bigint as n_copies, coalesce(n, 0)::bigint as n_grams
from documents d join class using (doc_id) left join n using (doc_id) left join copies using (whole)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _OP1, "op4_exact_dedup": _OP4, "op5_ngram_jaccard_join": _OP5, "op8_substring_dedup": _OP8, "op10_suffix_array_dedup": _OP10}

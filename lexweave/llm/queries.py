"""Queries of problems 2 to 10, and the SQL of those that SQL can express."""

from __future__ import annotations

from lexweave.llm import canonical_list, copies, encoding, frequency, lookalikes, packing, personal, residue, splits
from lexweave.llm.sql import SQL  # noqa: F401
from lexweave.sources.tables import table

QUERIES = {
    "p2_found": lambda s, d: copies.copies(table(s, d, "posts")),
    "p2_collapsed": lambda s, d: copies.collapse(table(s, d, "posts")).select("first_id", "n_copies"),
    "p3_found": lambda s, d: lookalikes.found(table(s, d, "posts"), table(s, d, "instances")),
    "p3_posts": lambda s, d: lookalikes.one_form(table(s, d, "posts"), "post_id", "post_txt"),
    "p3_mentions": lambda s, d: lookalikes.one_form(table(s, d, "instances"), "inst_id", "cand_match"),
    "p3_mention_posts": lambda s, d: lookalikes.one_form(table(s, d, "instances"), "inst_id", "post_txt"),
    "p4_found": lambda s, d: canonical_list.map_values(table(s, d, "typed_terms"), table(s, d, "lexicon")),
    "p4_unmatched": lambda s, d: canonical_list.unmatched(table(s, d, "typed_terms"), table(s, d, "lexicon")),
    "p5_found": lambda s, d: personal.found(table(s, d, "posts"), table(s, d, "given_names")),
    "p5_redacted": lambda s, d: personal.redact(table(s, d, "posts"), table(s, d, "given_names"), personal.session_key(table(s, d, "posts"))),
    "p6_found": lambda s, d: splits.found(table(s, d, "posts")),
    "p6_splits": lambda s, d: splits.assign_splits(table(s, d, "posts")),
    "p6_check": lambda s, d: splits.check(splits.assign_splits(table(s, d, "posts"))),
    "p6_forest": lambda s, d: splits.tree_sizes(table(s, d, "posts")),
    "p7_found": lambda s, d: frequency.marked(table(s, d, "instances")).where("mark is not null").select("term", "mark"),
    "p7_counts": lambda s, d: frequency.marked(table(s, d, "instances")),
    "p8_ids": lambda s, d: encoding.encode(table(s, d, "documents")),
    "p8_texts": lambda s, d: encoding.decode(encoding.encode(table(s, d, "documents"))),
    "p9_check": lambda s, d: packing.check(packing.containers(table(s, d, "documents"), 1024), 1024),
    "p9_containers": lambda s, d: packing.containers(table(s, d, "documents"), 4096),
    "p9_containers_1024": lambda s, d: packing.containers(table(s, d, "documents"), 1024),
    "p10_found": lambda s, d: residue.found(table(s, d, "documents")),
    "p10_clean": lambda s, d: residue.clean(table(s, d, "documents")).select("doc_id", "n_chars"),
    "p9_fill": lambda s, d: packing.fill(packing.containers(table(s, d, "documents"), 1024), 1024),
}

"""Schemas of the records that readers return. Production readers infer nothing."""

from __future__ import annotations

DOCUMENT = (
    "pmid STRING, version STRING, date STRING, language STRING, medline_status STRING, text_data ARRAY<STRUCT<text: STRING, type: STRING>>, "
    "publication_types ARRAY<STRING>, mesh_headings ARRAY<STRING>, data_banks ARRAY<STRUCT<name: STRING, id: STRING>>, authors ARRAY<STRING>"
)
# The columns of the concept table and of the predication table.
ATOM_COLUMNS = "cui lat ts lui stt sui ispref aui saui scui sdui sab tty code str srl suppress cvf".split()
PREDICATION_COLUMNS = "date pmid sent_idx ti_or_ab pred_type subj_ids subj_names subj_text subj_type obj_ids obj_names obj_text obj_type".split()
ARGUMENT = "STRUCT<id: STRING, cui: STRING, name: STRING, score: INT, negated: BOOLEAN, begin: INT, end: INT, maxDist: INT, dist: INT, relSemType: STRING>"
SEMREP = f"id STRING, entities ARRAY<STRING>, predicates ARRAY<STRUCT<negated: BOOLEAN, inferred: BOOLEAN, subject: {ARGUMENT}, predicate: STRUCT<type: STRING, indicatorType: STRING, begin: INT, end: INT>, object: {ARGUMENT}>>"
FULL_TEXT = (
    "paper_id STRING, metadata STRUCT<title: STRING, authors: ARRAY<STRUCT<first: STRING, last: STRING>>>, abstract ARRAY<STRUCT<text: STRING>>, "
    "body_text ARRAY<STRUCT<text: STRING>>, ref_entries MAP<STRING, STRUCT<text: STRING, type: STRING>>"
)

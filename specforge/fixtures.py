"""Derived input tables: portable SQL over the base tables, read by gated queries and inlined by their oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MATRIX_A = """
SELECT o_orderkey AS row_index,
  concat('REQ-', lpad(CAST(o_orderkey AS STRING), 7, '0')) AS req_id,
  CASE o_orderkey % 17 WHEN 0 THEN 'OK' WHEN 1 THEN '/' WHEN 2 THEN 'NOK' WHEN 3 THEN 'EE: ok' WHEN 4 THEN 'SW'
    WHEN 5 THEN 'N/A' WHEN 6 THEN 'ME/VE' WHEN 7 THEN 'a' WHEN 8 THEN '' WHEN 9 THEN 'Conforme'
    WHEN 10 THEN 'Non conforme' WHEN 11 THEN 'not ok' WHEN 12 THEN 'Glass is okay' WHEN 13 THEN 'Not applicable here'
    WHEN 14 THEN 'nok - see comment' WHEN 15 THEN 'to be confirmed' ELSE 'Oui' END AS conformity_raw,
  CASE o_custkey % 13 WHEN 0 THEN '' WHEN 1 THEN 'EE: ok SW: ok' WHEN 2 THEN 'to be confirmed by supplier'
    WHEN 3 THEN 'cannot be met, not possible' WHEN 4 THEN 'partial, limited to front doors' WHEN 5 THEN 'sw/ee'
    WHEN 6 THEN 'test failed, defect open' WHEN 7 THEN 'validated on bench' WHEN 8 THEN 'deviation requested'
    WHEN 9 THEN 'pending, still missing data' WHEN 10 THEN 'not applicable' WHEN 11 THEN 'v2' ELSE 'same as previous' END AS comment,
  CASE o_orderkey % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'B' WHEN 2 THEN '' ELSE 'v2' END AS version
FROM orders
"""

MATRIX_B = """
SELECT row_index, req_id,
  CASE WHEN row_index % 5 = 0 THEN 'OK' WHEN row_index % 5 = 1 THEN 'NOK' ELSE conformity_raw END AS conformity_raw,
  comment, version
FROM fx_matrix_a WHERE row_index % 11 <> 0
UNION ALL
SELECT o_orderkey + 9000000, concat('REQ-', lpad(CAST(o_orderkey + 9000000 AS STRING), 7, '0')), 'OK', '', 'v3'
FROM orders WHERE o_orderkey % 11 = 0
"""

SPEC_LINES = """
SELECT doc_id, line_no, CASE line_no % 12
    WHEN 0 THEN CASE CAST(floor(line_no / 12.0) AS BIGINT) % 9 WHEN 0 THEN 'PURPOSE' WHEN 1 THEN 'SCOPE' WHEN 2 THEN 'REFERENCE DOCUMENTS'
        WHEN 3 THEN 'APPLICABLE DOCUMENTS' WHEN 4 THEN 'FUNCTIONAL REQUIREMENTS' WHEN 5 THEN 'PERFORMANCE REQUIREMENTS'
        WHEN 6 THEN 'GLOSSARY' WHEN 7 THEN 'RAMS REQUIREMENTS' ELSE 'MISSION PROFILE' END
    WHEN 1 THEN concat('The system shall provide the ', p_name, ' function when the ignition is on.')
    WHEN 2 THEN ''
    WHEN 3 THEN concat('REF-PSP-COMP-', lpad(CAST(p_partkey AS STRING), 4, '0'), ' | The unit shall hold ', p_name, ' during idle. | N/A')
    WHEN 4 THEN concat('APP-ASU-CD-', lpad(CAST(p_partkey AS STRING), 4, '0'), ' | The unit shall survive several cycles of ', p_name, '. | [SSD_AUE]')
    WHEN 5 THEN CASE p_partkey % 3 WHEN 0 THEN 'Value TBD, see <<fill value>>' WHEN 1 THEN 'Value XXX and tbc' ELSE 'Value is final' END
    WHEN 6 THEN ''
    WHEN 7 THEN concat('[STA', CAST(p_size % 7 AS STRING), '] | 98037030 | part drawing')
    WHEN 8 THEN concat('[N', CAST(p_size % 5 AS STRING), '] | CS.00244 | EMC requirements')
    WHEN 9 THEN concat('Comply with [STA', CAST(p_partkey % 9 AS STRING), '] and [N', CAST(p_partkey % 6 AS STRING), '] in service.')
    WHEN 10 THEN concat('Supply ', CAST(p_size AS STRING), ' V, level ', CAST(100 + p_size AS STRING), ' dB, within ', CAST(p_size * 10 AS STRING), ' ms, duty ', CAST(p_size * 3 AS STRING), ' %')
    ELSE concat('Switch from Idle', CAST(p_size % 4 AS STRING), ' to Active', CAST(p_size % 3 AS STRING), '.') END AS line
FROM (SELECT p_partkey % 20 AS doc_id, CAST(floor(p_partkey / 20.0) AS BIGINT) AS line_no, p_partkey, p_name, p_size FROM part) p
"""

QA_EVENTS = """
SELECT event_id, ts, user_id, value AS top_score, event_id % 6 AS source_count,
  event_type = 'error' AS was_not_found, event_type = 'signup' AS was_refusal,
  (event_id % 6) > 0 AS had_sources,
  CASE event_type WHEN 'click' THEN 'HIGH' WHEN 'purchase' THEN 'MEDIUM' WHEN 'view' THEN CASE WHEN event_id % 4 = 0 THEN '' ELSE 'LOW' END ELSE '' END AS confidence
FROM events
"""

ASKED = (
    "Where is the ertion of the thing?", "the and of", "validate the document", "what is this document about", "look up the standards for noise",
    "que la porte dans le document", "what does ASU stand for", "how to write the scope section", "help", "maximum noise level of the unit",
    "What should I put in the reference documents?", "REQUIREMENTS?", "composant", "check if the file is compliant", "summarize the spec", "tell me about ISO 26262",
    "what is the wiring voltage", "que doit contenir la section glossaire", "power consumption of the unit at rest", "describe the file unit 3 door",
    "which test procedure is given for the packaging process", "what is the purpose of the door unit", "explain the acronymes", "comment rédiger la section exigences",
    "how many cycles shall the unit withstand", "zzzz qqqq xxxx", "validate unit 5 door", "what goes in the mission profile", "state machine of the door", "environmental heat",
)
_quote = lambda s: "'" + s.replace("'", "''") + "'"
QUESTIONS = f"SELECT * FROM (VALUES {', '.join(f'({k + 1}, {_quote(q)})' for k, q in enumerate(ASKED))}) AS t(q_id, question)"

#: Wide supplier rows: several status columns, a customer verdict, versions; built on the first matrix.
WIDE = """
SELECT row_index, req_id, conformity_raw AS s0, comment AS c0,
  CASE row_index % 7 WHEN 0 THEN 'EE: ok' WHEN 1 THEN 'SW: nok' WHEN 2 THEN 'sw/ee' WHEN 3 THEN '' WHEN 4 THEN 'ok' WHEN 5 THEN 'n/a' ELSE 'pending' END AS s1,
  CASE row_index % 5 WHEN 0 THEN 'see report' WHEN 1 THEN '' WHEN 2 THEN comment ELSE 'v2' END AS c1,
  CASE row_index % 9 WHEN 0 THEN 'NOK' WHEN 1 THEN 'ok' WHEN 2 THEN 'to check' ELSE '' END AS verdict,
  version, CASE row_index % 6 WHEN 0 THEN 'V3' ELSE '' END AS applicable
FROM fx_matrix_a
"""

#: Lines that specifications are made of: headings, and sentences that rules of the writing guide look for.
PHRASES = (
    "PURPOSE", "SCOPE", "SYSTEM DIVERSITY", "REFERENCE DOCUMENTS", "APPLICABLE DOCUMENTS", "STANDARDS", "ACRONYMS", "FUNCTIONAL REQUIREMENTS",
    "PERFORMANCE REQUIREMENTS", "EXTERNAL INTERFACES", "NETWORK INTERFACES", "ELECTRICAL INTERFACES", "OPERATIONAL REQUIREMENTS", "MISSION PROFILE",
    "RAMS REQUIREMENTS", "CONSTRAINT REQUIREMENTS", "DESIGN AND MANUFACTURING", "ENVIRONMENT CONDITIONS", "REQUIREMENTS", "REQUIREMENTS DOCUMENT",
    "2.1 Purpose", "Reference documents", "3 GLOSSARY", "GENERAL DESCRIPTION OF THE SYSTEM", "Table of updates", "Written by A. Writer, checked by B. Checker",
    "Specification of the door unit", "see figure 3 and table 4", "Figure 12 shows the sequence diagram", "ASU: Alarm Siren Unit", "The text in red is to be removed",
    "le système et la fonction du composant", "This generic specification holds per project values to be defined", "Valid for all projects", "variant | left | right",
    "The characteristic of each variant", "00998_20_01234 revision C", "00998_20_01235", "Design file of the upstream functional requirements", "The state machine is shown below",
    "The unit shall send 0x1F on start of the cycle", "Noise level under test", "The regulation requirement is met", "The assembly process shall be described by the supplier",
    "No internal functional analysis is given", "When the door opens the unit shall report its state", "Dependability and safety are studied", "A contextual diagram is given",
    "Power supply and current", "The wiring diagram is attached", "Power consumption at rest shall stay low", "The test procedure is not given here", "The packaging process of the part",
    "Recycling of the part", "The network interface is a constraint of the design", "The network frame shall hold the state", "List of I/O", "Participants: none",
    "REF-PSP-COMP-0001 | The unit shall open within the time that the plan gives | N/A", "APP-ASU-CD-0002 | The unit shall withstand several cycles of use | [SSD_AUE]",
    "[STA20] | 98037030 | part drawing", "[N41] | CS.00244 | EMC requirements", "Comply with [STA20] and [n7] in service", "The value is TBD and <<fill in the value>>",
    "<component name> of the car", "The supplier should answer and may ask", "Delete this sentence of the template before you submit the document", "one | two | three", "", "plain text", "7\tTERMINOLOGY\t31", "1.1 Sources", "The unit is based on the requirement of the plan and shall hold", "See ISO 16750 and N/A", "NA",
    "Idle state: waits", "Alarm mode - rings", "The unit can switch from Idle to Alarm.", "It may go from Sleep to Idle, then waits", "move from Ready to Closed and stop", "transition Test into Halt.", "### 1.2.3 Deep part", "4. TRACEABILITY - overview",
    "<<(*) example of text>>", "Value XXX of the part", "comply with [N41] as specified in [STA20]",
)
_listed = ", ".join(f"({k}, '{p}')" for k, p in enumerate(PHRASES))
#: Long specifications of these lines, by part number: 40 documents.
GUIDE_LINES = f"""
SELECT l.doc_id, l.line_no, f.phrase AS line FROM (
  SELECT p_partkey % 40 AS doc_id, CAST(floor(p_partkey / 40.0) AS BIGINT) AS line_no, (p_partkey * 37 + p_size * 11 + CAST(floor(p_partkey / 40.0) AS BIGINT) * 17) % {len(PHRASES)} AS k FROM part) AS l
JOIN (SELECT * FROM (VALUES {_listed}) AS v(k, phrase)) AS f ON l.k = f.k
"""

TEXTS = {
    "fx_matrix_a": MATRIX_A, "fx_matrix_b": MATRIX_B, "fx_spec_lines": SPEC_LINES,
    "fx_qa_events": QA_EVENTS, "fx_questions": QUESTIONS, "fx_wide": WIDE, "fx_guide_lines": GUIDE_LINES,
}
NEEDS = {"fx_matrix_b": ("fx_matrix_a",), "fx_wide": ("fx_matrix_a",)}
BASE_TABLES = ("orders", "part", "events")


def cte(*names: str) -> str:
    """WITH clause of these fixtures for an oracle, without the final select."""
    every = list(dict.fromkeys(x for n in names for x in (*NEEDS.get(n, ()), n)))
    return "WITH " + ",\n".join(f"{n} AS ({TEXTS[n].strip()})" for n in every)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frames: dict[str, DataFrame] = {}

    def bound(match: re.Match) -> str:
        what = match[1]
        frames[what] = fixture(spark, sf_dir, what) if what in TEXTS else spark.read.parquet(f"{sf_dir}/{what}.parquet")
        return "FROM {" + what + "}"

    names = "|".join((*BASE_TABLES, *TEXTS))
    return spark.sql(re.sub(rf"FROM ({names})\b", bound, TEXTS[name]), **frames)

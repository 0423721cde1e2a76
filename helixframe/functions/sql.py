"""SQL functions on sequences, defined in SQL: queries that use them have no Python in their plans.

``register`` defines temporary functions of the session:

* ``dna_pack(bases)``: identifier of 1 to 32 clean bases, else null
* ``dna_unpack(id, length)``: bases of an identifier, in lower case
* ``dna_revcomp(bases)``, ``dna_revcomp_id(id, length)``: reverse complements
* ``dna_low_quality(quals, threshold)``: characters below a code
* ``dna_mismatches(a, b)``: bases in which two identifiers of one length differ
* ``dna_window_list(bases, length)``: array of (pos, w), the windows that a read has, null if none
* ``dna_windows(bases, length)``: table of the same
* ``dna_neighbors(id, k, lowest)``: table of (neighbor), identifiers with one base changed, from bit position ``lowest`` on
* ``dna_differences(a, b, length)``: table of (pos, new, old), right to left
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_DIGITS = "translate(upper(bases), 'ACGT', '0123')"


def _windows(function: str) -> str:
    """Windows of clean bases, if one of them starts before the last place; table functions can't call scalar ones."""
    return f"""
        transform(array(filter(
            transform(CASE WHEN length(bases) > {function}.length THEN sequence(0, length(bases) - {function}.length) END,
                      p -> named_struct('pos', p, 'w', upper(substr(bases, p + 1, {function}.length)))),
            x -> NOT x.w RLIKE '[^ACGT]')), v -> CASE WHEN exists(v, x -> x.pos < length(bases) - {function}.length) THEN v END)[0]"""


#: Name and signature, kind of result, body.
FUNCTIONS = [
    ("dna_pack(bases STRING)", "BIGINT", f"""
        CASE WHEN NOT bases RLIKE '^[ACGTacgt]{{1,32}}$' THEN NULL
             WHEN length(bases) <= 16 THEN CAST(conv({_DIGITS}, 4, 10) AS BIGINT)
             ELSE shiftleft(CAST(conv(left({_DIGITS}, length(bases) - 16), 4, 10) AS BIGINT), 32) | CAST(conv(right({_DIGITS}, 16), 4, 10) AS BIGINT) END"""),
    ("dna_unpack(id BIGINT, length INT)", "STRING", """
        array_join(transform(sequence(dna_unpack.length - 1, 0, -1), p -> substr('acgt', CAST(shiftrightunsigned(id, 2 * p) & 3 AS INT) + 1, 1)), '')"""),
    ("dna_revcomp(bases STRING)", "STRING", "translate(reverse(bases), 'ACGTacgt', 'TGCAtgca')"),
    ("dna_revcomp_id(id BIGINT, length INT)", "BIGINT", """
        aggregate(sequence(0, dna_revcomp_id.length - 1), 0L, (acc, p) -> shiftleft(acc, 2) | (3 - (shiftrightunsigned(id, 2 * p) & 3)))"""),
    ("dna_low_quality(quals STRING, threshold INT)", "INT", "size(filter(split(quals, ''), c -> c <> '' AND ascii(c) < threshold))"),
    ("dna_mismatches(a BIGINT, b BIGINT)", "INT", "bit_count(((a ^ b) | shiftrightunsigned(a ^ b, 1)) & 6148914691236517205L)"),
    ("dna_window_list(bases STRING, length INT)", "ARRAY<STRUCT<pos: INT, w: STRING>>", _windows("dna_window_list")),
    ("dna_windows(bases STRING, length INT)", "TABLE(pos INT, w STRING)", f"SELECT inline({_windows('dna_windows')})"),
    ("dna_neighbors(id BIGINT, k INT, lowest INT)", "TABLE(neighbor BIGINT)", """
        SELECT explode(flatten(transform(CASE WHEN lowest < k THEN sequence(lowest, k - 1) END, p -> transform(array(1L, 2L, 3L), x -> id ^ shiftleft(x, 2 * p)))))"""),
    ("dna_differences(a BIGINT, b BIGINT, length INT)", "TABLE(pos INT, new INT, old INT)", """
        SELECT inline(filter(transform(sequence(0, dna_differences.length - 1), p -> named_struct('pos', dna_differences.length - 1 - p,
            'new', CAST(shiftrightunsigned(a, 2 * p) & 3 AS INT), 'old', CAST(shiftrightunsigned(b, 2 * p) & 3 AS INT))), e -> e.new <> e.old))"""),
]


def register(spark: SparkSession) -> None:
    """Defines the functions in the session; defining them again changes nothing."""
    for signature, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")

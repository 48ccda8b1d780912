"""The llm operators' driver queries."""

from __future__ import annotations

from weftspark.llm import incremental, languages, leaks, lookalike, mixing, near_dups, pairs, pieces, residue, vectors


def queries() -> dict:
    return {
        "p1_found": vectors.p1_found,
        "p2_found": near_dups.p2_found,
        "p3_found": lookalike.p3_found,
        "p4_found": incremental.p4_found,
        "p5_found": pieces.p5_found,
        "p5_pieces": pieces.p5_pieces,
        "p5_file_pieces": pieces.p5_file_pieces,
        "p6_found": languages.p6_found,
        "p6_segments": languages.p6_segments,
        "p7_found": pairs.p7_found,
        "p8_found": leaks.p8_found,
        "p9_mix": mixing.p9_mix,
        "p9_shares": mixing.p9_shares,
        "p10_found": residue.p10_found,
    }


def oracle_sql() -> dict[str, str]:
    return {}

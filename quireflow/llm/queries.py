"""The subpackage's queries."""

from . import lookalikes, mixing, mojibake, scans, sentences, tokens

QUERIES = {
    "p1_found": mojibake.p1_found,
    "p1_restored": mojibake.p1_restored,
    "p2_found": scans.p2_found,
    "p2_paragraphs": scans.p2_paragraphs,
    "p5_found": lookalikes.p5_found,
    "p5_plain": lookalikes.p5_plain,
    "p5_lines": lookalikes.p5_lines,
    "p6_ids": tokens.p6_ids,
    "p7_mixture": mixing.p7_mixture,
    "p7_shares": mixing.p7_shares,
    "p8_found": sentences.p8_found,
}
SQL: dict[str, str] = {}

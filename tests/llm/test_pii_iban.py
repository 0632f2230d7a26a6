"""IBANs before capitals."""

from __future__ import annotations

from cases import documents

from basketlake.llm import pii

IBAN = "DE89370400440532013000"


def test_iban_spans(spark):
    cases = [(f"IBAN {IBAN} BIC COBADEFFXXX", "iban:5:27"), ("DE89 3704 0044 0532 0130 00 EUR 500", "iban:0:27"), (f"AB12 {IBAN} X", "iban:5:27"), (f"x{IBAN}", ""), (f"{IBAN}A", "")]
    rows = {r["doc_id"]: r["spans"].strip(",") for r in pii.pii_digest(documents(spark, [t for t, _ in cases])).collect()}
    assert rows == {i: want for i, (_, want) in enumerate(cases)}

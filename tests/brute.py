"""Plain definitions, one row at a time, to check the distributed jobs against."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

CENT = Decimal("0.01")


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def _aligned(needle: str, hay: str) -> float:
    n, m = len(needle), len(hay)
    best = 0.0
    for start in range(2 - n, m + 1):
        window = hay[max(start, 1) - 1 : min(start + n - 1, m)]
        best = max(best, 200 * lcs(needle, window) / (n + len(window)))
    return best


def similarity(a: str | None, b: str | None) -> float:
    a, b = a or "", b or ""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    if len(a) == len(b):
        return max(_aligned(a, b), _aligned(b, a))
    return _aligned(a, b) if len(a) < len(b) else _aligned(b, a)


def in_gate(pg: dict, row: dict) -> bool:
    return abs(pg["net"] - row["amount"]) <= CENT and abs((pg["day"] - row["day"]).days) <= 3


def candidates(pg: dict, bank: list[dict], invoices: list[dict]) -> dict:
    tier, rows = "none", []
    if pg["utr"]:
        rows = [b for b in bank if b["utr"] == pg["utr"]]
        tier = "exact_utr" if rows else tier
    if not rows and pg["txn"]:
        rows = [b for b in bank if b["txn"] == pg["txn"]]
        tier = "exact_txn" if rows else tier
    if not rows:
        rows = [b for b in bank if in_gate(pg, b) and similarity(pg["utr"], b["narration"]) >= 85]
        tier = "fuzzy" if rows else tier
    chosen = {b["pos"] for b in rows}
    rivals = [
        b
        for b in bank
        if b["pos"] not in chosen and in_gate(pg, b) and not (pg["txn"] and b["txn"] and b["txn"] == pg["txn"])
    ]
    bills = [i for i in invoices if pg["txn"] and i["txn"] == pg["txn"]]

    def copies(items: list[dict]) -> bool:
        return len(items) >= 2 and len({(i["txn"], i.get("utr"), i["amount"], i["day"]) for i in items}) == 1

    best = min(
        rows,
        key=lambda b: (abs((b["day"] - pg["day"]).days), abs(pg["net"] - b["amount"]), b["utr"] or "", b["pos"]),
        default=None,
    )
    bill = min(bills, key=lambda i: (abs(pg["bill"] - i["amount"]), i["pos"]), default=None)
    return {
        "tier": tier,
        "bank": best and best["pos"],
        "invoice": bill and bill["pos"],
        "bank_n": len(rows),
        "invoice_n": len(bills),
        "rivals": len(rivals),
        "duplicate": copies(rows) or copies(bills),
    }


def multiset(rows) -> Counter:
    return Counter(rows)

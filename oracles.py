"""SQL of the same results on the driver tables, for the side-by-side check.

Written pairwise, as the definitions read: candidates are joined row by row and ranked, where the
Spark jobs summarise groups. Money, dates and lists are text on both sides.
"""

from __future__ import annotations

import re

# Each entry: name -> query. A query below may use any earlier one.
CTES: dict[str, str] = {}

CTES["settle0"] = """
SELECT o_orderkey AS k, o_orderkey % 25 AS slot,
  'MERCH_' || lpad(CAST(o_custkey % 50 AS VARCHAR), 3, '0') AS merchant_id,
  CAST(o_totalprice AS DECIMAL(18,2)) AS gross,
  CASE WHEN o_orderkey % 25 = 5 THEN 'CARD' WHEN o_orderkey % 3 = 0 THEN 'UPI'
       WHEN o_orderkey % 3 = 1 THEN 'CARD' ELSE 'NETBANKING' END AS method,
  CAST(o_orderdate AS DATE) AS day,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS ts,
  CAST(CASE WHEN o_orderkey % 25 = 2 THEN 0 ELSE (o_orderkey * 7919) % 900000 END AS DECIMAL(18,2)) AS opening,
  s.sibling
FROM orders JOIN (VALUES (0), (1)) s(sibling) ON s.sibling = 0 OR o_orderkey % 25 = 2"""

CTES["settle1"] = """
SELECT *, CAST(round(gross * CASE method WHEN 'UPI' THEN CAST(0 AS DECIMAL(6,4))
    WHEN 'CARD' THEN CAST(0.02 AS DECIMAL(6,4)) ELSE CAST(0.018 AS DECIMAL(6,4)) END, 2) AS DECIMAL(18,2)) AS fee,
  CASE WHEN sibling = 1 THEN 'PYT_' ELSE 'TXN_' END
    || CASE WHEN k < 100000000 THEN lpad(CAST(k AS VARCHAR), 8, '0') ELSE CAST(k AS VARCHAR) END AS txn_id,
  CASE WHEN sibling = 1 THEN 'UTS' ELSE 'UTR' END
    || CAST(100000000 + (k * 7919) % 899999999 + (k // 899999999) * 1000000000 AS VARCHAR) AS utr
FROM settle0"""

CTES["settle"] = """
SELECT *, CAST(gross - fee - gst - tds AS DECIMAL(18,2)) AS net FROM (
  SELECT *, CAST(round(fee * CAST(0.18 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS gst,
    CAST(CASE WHEN opening + gross > 500000 THEN round(gross * CAST(0.001 AS DECIMAL(4,3)), 2) ELSE 0 END AS DECIMAL(18,2)) AS tds
  FROM settle1)"""

CTES["pg_raw"] = """
SELECT k * 2 + sibling AS src_pos, 'SET_' || txn_id AS settlement_id, txn_id, merchant_id,
  CASE WHEN slot = 0 THEN 'NOT_A_NUMBER' ELSE CAST(gross AS VARCHAR) END AS gross_amount,
  CAST(fee AS VARCHAR) AS pg_fee, CAST(gst AS VARCHAR) AS gst_on_fee, CAST(tds AS VARCHAR) AS tds_withheld,
  CAST(net AS VARCHAR) AS net_payout, CAST(opening AS VARCHAR) AS merchant_ytd_gross_opening,
  method AS payment_method, utr, ts AS "timestamp" FROM settle"""

CTES["bank_raw"] = """
SELECT k * 4 + c.copy + sibling * 2 AS src_pos,
  CASE WHEN slot IN (9, 10, 12) THEN 'HDFC0001234N' || CAST(10000000 + k AS VARCHAR)
       ELSE 'BANKREF_' || txn_id || CASE WHEN c.copy = 1 THEN '_DUP' ELSE '' END END AS bank_ref,
  CASE WHEN slot NOT IN (9, 10, 13) THEN utr END AS utr,
  CAST(CAST(CASE slot WHEN 7 THEN net - 5 WHEN 8 THEN net - 0.75 WHEN 13 THEN net - 50 WHEN 14 THEN -net ELSE net END
    AS DECIMAL(18,2)) AS VARCHAR) AS credited_amount,
  CAST(day + CAST(CASE slot WHEN 11 THEN 2 WHEN 12 THEN 3 WHEN 13 THEN 9 ELSE 1 END AS INTEGER) AS VARCHAR) AS value_date,
  CASE WHEN slot = 12 THEN 'SETTLEMENT ' || lower(txn_id) || ' ' || utr
    ELSE CASE (k // 25) % 5
      WHEN 0 THEN 'NEFT-HDFC0001234-' || ref || '-' || merchant_id
      WHEN 1 THEN 'IMPS/' || CAST(100000000000 + k AS VARCHAR) || '/' || ref || '/SETTLEMENT'
      WHEN 2 THEN 'BY TRANSFER-NEFT*HDFC*' || ref || '*GATEWAY-'
      WHEN 3 THEN 'RTGS CR ' || ref || ' ' || merchant_id || ' SETTLEMENT'
      ELSE 'UPI/' || ref || '/' || merchant_id || '/NET STLMNT' END END AS narration
FROM (SELECT *, CASE WHEN slot = 10 THEN substr(utr, 1, at_pos - 1)
        || CASE WHEN substr(utr, at_pos, 1) = '3' THEN '8' ELSE '3' END || substr(utr, at_pos + 1) ELSE utr END AS ref
      FROM (SELECT *, CAST((k // 25) % 12 + 1 AS INTEGER) AS at_pos FROM settle WHERE slot <> 3))
JOIN (VALUES (0), (1)) c(copy) ON c.copy = 0 OR slot = 1"""

CTES["inv_raw"] = """
SELECT k * 2 + sibling AS src_pos, 'INV_' || txn_id AS invoice_id, txn_id, sha256(txn_id) AS irn, '29AAAAA' || substr(merchant_id, 7, 3) || 'A1Z5' AS gstin,
  CAST(CAST(fee + gst AS DECIMAL(18,2)) AS VARCHAR) AS invoice_amount,
  CAST(CAST(CASE WHEN slot = 5 THEN round(fee * CAST(0.12 AS DECIMAL(3,2)), 2) ELSE gst END AS DECIMAL(18,2)) AS VARCHAR) AS claimed_gst,
  CAST(CAST(CASE WHEN slot = 6 THEN round(gross * CAST(0.01 AS DECIMAL(3,2)), 2) ELSE tds END AS DECIMAL(18,2)) AS VARCHAR) AS claimed_tds,
  strftime(day, '%Y-%m') AS period FROM settle WHERE slot <> 4"""

CTES["lab"] = """
SELECT txn_id,
  CASE slot WHEN 0 THEN 'UNMATCHED' WHEN 1 THEN 'HUMAN_REVIEW' WHEN 2 THEN 'AMBIGUOUS' WHEN 3 THEN 'UNMATCHED'
    WHEN 4 THEN 'PARTIAL_MATCH' WHEN 5 THEN 'TAX_MISMATCH' WHEN 6 THEN 'TAX_MISMATCH' WHEN 7 THEN 'HUMAN_REVIEW'
    WHEN 8 THEN 'HUMAN_REVIEW' WHEN 13 THEN 'HUMAN_REVIEW' WHEN 14 THEN 'UNMATCHED' ELSE 'MATCHED' END AS expected_status,
  CASE slot WHEN 0 THEN 'CORRUPTED_RECORD' WHEN 1 THEN 'DUPLICATE_DETECTED' WHEN 2 THEN 'AMBIGUOUS_MATCH'
    WHEN 3 THEN 'MISSING_IN_BANK' WHEN 4 THEN 'MISSING_IN_INVOICE' WHEN 5 THEN 'ERR_GST_MISMATCH' WHEN 6 THEN 'ERR_TDS_VARIANCE'
    WHEN 7 THEN 'AMOUNT_MISMATCH' WHEN 8 THEN 'AMOUNT_MISMATCH' WHEN 13 THEN 'AMOUNT_MISMATCH' WHEN 14 THEN 'MISSING_IN_BANK'
    ELSE 'NONE' END AS expected_exception_code,
  CASE slot WHEN 0 THEN 'corrupted' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'missing_in_source'
    WHEN 4 THEN 'missing_in_source' WHEN 5 THEN 'tax_mismatch' WHEN 6 THEN 'tax_mismatch' WHEN 7 THEN 'amount_fee_discrepancy'
    WHEN 8 THEN 'amount_fee_discrepancy' WHEN 9 THEN 'reference_mismatch_fuzzy' WHEN 10 THEN 'reference_mismatch_fuzzy'
    WHEN 11 THEN 'timing_difference' WHEN 12 THEN 'timing_difference' WHEN 13 THEN 'unresolvable' WHEN 14 THEN 'refund'
    ELSE 'exact_match' END AS category
FROM settle"""

CTES["pg"] = """
SELECT src_pos, txn_id, utr, merchant_id, payment_method, amount, fee, gst, tds, opening, day,
  CAST(amount - fee - gst - tds AS DECIMAL(18,4)) AS net, CAST(fee + gst AS DECIMAL(18,4)) AS bill
FROM (SELECT *, TRY_CAST(gross_amount AS DECIMAL(18,4)) AS amount, CAST(pg_fee AS DECIMAL(18,4)) AS fee,
  CAST(gst_on_fee AS DECIMAL(18,4)) AS gst, CAST(tds_withheld AS DECIMAL(18,4)) AS tds,
  CAST(merchant_ytd_gross_opening AS DECIMAL(18,4)) AS opening, CAST(substr("timestamp", 1, 10) AS DATE) AS day FROM pg_raw)
WHERE amount >= 0"""

CTES["bank"] = """
SELECT src_pos, bank_ref, utr, amount, day, narration, COALESCE(by_ref, by_text) AS txn_id,
  CASE WHEN by_ref IS NOT NULL THEN 'bank_ref' WHEN by_text IS NOT NULL THEN 'narration' ELSE 'unresolved' END AS link_method
FROM (SELECT *, CAST(credited_amount AS DECIMAL(18,4)) AS amount, CAST(value_date AS DATE) AS day,
    CASE WHEN starts_with(bank_ref, 'BANKREF_') THEN nullif(split_part(substr(bank_ref, 9), '_DUP', 1), '') END AS by_ref,
    COALESCE(nullif(upper(regexp_extract(narration, '(?i)TXN_[0-9]{5,8}')), ''),
             nullif(upper(regexp_extract(narration, '(?i)TXN-[0-9]{4}-[0-9]{4,8}')), ''),
             nullif(upper(regexp_extract(narration, '(?i)PYT_[0-9]{7,8}')), '')) AS by_text
  FROM bank_raw)
WHERE amount >= 0"""

CTES["inv"] = """
SELECT src_pos, invoice_id, txn_id, CAST(invoice_amount AS DECIMAL(18,4)) AS amount,
  CAST(CAST(invoice_amount AS DECIMAL(18,4)) - CAST(claimed_gst AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS fee,
  CAST(claimed_gst AS DECIMAL(18,4)) AS gst, CAST(claimed_tds AS DECIMAL(18,4)) AS tds,
  CAST(period || '-01' AS DATE) AS day, period FROM inv_raw"""

CTES["rej"] = """
SELECT 'pg' AS source, src_pos, 'gross_amount:NOT_A_NUMBER' AS message, 'SCHEMA_VALIDATION_FAILED' AS error_code
FROM pg_raw WHERE TRY_CAST(gross_amount AS DECIMAL(18,4)) IS NULL
UNION ALL
SELECT 'bank', src_pos, 'credited_amount:UNSUPPORTED_TRANSACTION_TYPE', 'UNSUPPORTED_TRANSACTION_TYPE'
FROM bank_raw WHERE CAST(credited_amount AS DECIMAL(18,4)) < 0"""

CTES["e1"] = """
SELECT p.src_pos AS a, b.src_pos AS b, 'exact_utr' AS tier FROM pg p JOIN bank b ON p.utr = b.utr"""
CTES["e2"] = """
SELECT p.src_pos AS a, b.src_pos AS b, 'exact_txn' AS tier FROM pg p JOIN bank b ON p.txn_id = b.txn_id
WHERE NOT EXISTS (SELECT 1 FROM e1 WHERE e1.a = p.src_pos)"""
CTES["gate"] = """
SELECT p.src_pos AS a, b.src_pos AS b, p.txn_id AS a_txn, b.txn_id AS b_txn
FROM pg p JOIN bank b ON b.amount BETWEEN p.net - 0.01 AND p.net + 0.01
WHERE abs(date_diff('day', p.day, b.day)) <= 3"""
CTES["open_pairs"] = """
SELECT g.a, g.b, p.utr AS ref, b.narration AS txt FROM gate g JOIN pg p ON p.src_pos = g.a JOIN bank b ON b.src_pos = g.b
WHERE NOT EXISTS (SELECT 1 FROM e1 WHERE e1.a = g.a) AND NOT EXISTS (SELECT 1 FROM e2 WHERE e2.a = g.a)"""


def _similarity(pairs: str) -> str:
    """Similarity of the distinct (ref, txt) of ``pairs``."""
    return f"""
SELECT ref, txt, list_max(list_transform(range(2 - n, m + 1), lambda s:
    200.0 * (n - bit_count(list_reduce(list_slice(masks, greatest(s, 1), least(s + n - 1, m)),
       lambda v, q: ((v + (v & q)) | (v & ~q)) & ones, ones)))
    / (n + least(s + n - 1, m) - greatest(s, 1) + 1))) AS sim
FROM (SELECT *, (CAST(1 AS BIGINT) << CAST(n AS INTEGER)) - 1 AS ones,
    list_transform(string_split(txt, ''), lambda c: CAST(list_sum(list_transform(range(0, n), lambda i:
      CASE WHEN substr(ref, i + 1, 1) = c THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE CAST(0 AS BIGINT) END)) AS BIGINT)) AS masks
  FROM (SELECT DISTINCT ref, txt, length(ref) AS n, length(txt) AS m FROM {pairs}))"""


CTES["sims"] = _similarity("open_pairs")
CTES["e3"] = """
SELECT o.a, o.b, 'fuzzy' AS tier FROM open_pairs o JOIN sims s ON o.ref = s.ref AND o.txt = s.txt WHERE s.sim >= 85"""
CTES["edge"] = "SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3"
CTES["ranked"] = """
SELECT e.a, e.b, e.tier, b.txn_id, b.utr, b.amount, b.day, b.bank_ref, row_number() OVER (PARTITION BY e.a
    ORDER BY abs(date_diff('day', p.day, b.day)), abs(p.net - b.amount), COALESCE(b.utr, ''), b.src_pos) AS rn,
  count(*) OVER (PARTITION BY e.a) AS n
FROM edge e JOIN pg p ON p.src_pos = e.a JOIN bank b ON b.src_pos = e.b"""
CTES["dupb"] = """
SELECT a, count(*) >= 2 AND count(DISTINCT concat_ws('|', COALESCE(txn_id, '?'), COALESCE(utr, '?'), CAST(amount AS VARCHAR), CAST(day AS VARCHAR))) = 1 AS dup
FROM ranked GROUP BY a"""
CTES["iranked"] = """
SELECT p.src_pos AS a, i.*, row_number() OVER (PARTITION BY p.src_pos ORDER BY abs(p.bill - i.amount), i.src_pos) AS rn,
  count(*) OVER (PARTITION BY p.src_pos) AS n FROM pg p JOIN inv i ON i.txn_id = p.txn_id"""
CTES["amb"] = """
SELECT g.a, count(*) AS n FROM gate g
WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.a = g.a AND e.b = g.b) AND NOT COALESCE(g.a_txn = g.b_txn, FALSE)
GROUP BY g.a"""
CTES["gated"] = "SELECT a, count(*) AS n FROM gate GROUP BY a"
CTES["m0"] = """
SELECT p.src_pos, p.txn_id, p.utr, p.merchant_id, p.amount, p.fee, p.gst, p.tds, p.opening, p.day, p.net, p.bill,
  w.b AS b_pos, w.bank_ref AS b_ref, w.txn_id AS b_txn, w.utr AS b_utr, w.amount AS b_amount, w.day AS b_day,
  v.invoice_id AS i_id, v.txn_id AS i_txn, v.amount AS i_amount, v.fee AS i_fee, v.gst AS i_gst, v.tds AS i_tds, v.day AS i_day,
  COALESCE(w.tier, 'none') AS tier, COALESCE(w.n, 0) AS bank_n, COALESCE(v.n, 0) AS inv_n, COALESCE(x.n, 0) AS amb_n,
  COALESCE(g.n, 0) AS gated_n, COALESCE(d.dup, FALSE) AS dup, w.b IS NOT NULL AS has_b, v.invoice_id IS NOT NULL AS has_i
FROM pg p LEFT JOIN ranked w ON w.a = p.src_pos AND w.rn = 1 LEFT JOIN iranked v ON v.a = p.src_pos AND v.rn = 1
LEFT JOIN amb x ON x.a = p.src_pos LEFT JOIN gated g ON g.a = p.src_pos LEFT JOIN dupb d ON d.a = p.src_pos"""
CTES["m1"] = """
SELECT *, NOT dup AND (bank_n > 1 OR inv_n > 1 OR amb_n > 0) AS is_amb,
  COALESCE(b_txn = txn_id, FALSE) AS s_tb, COALESCE(i_txn = txn_id, FALSE) AS s_ti,
  COALESCE(abs(net - b_amount) <= 0.01, FALSE) AS s_ab, COALESCE(abs(bill - i_amount) <= 0.01, FALSE) AS s_ai,
  abs(date_diff('day', day, b_day)) AS d_b, abs(date_diff('day', day, i_day)) AS d_i,
  COALESCE(utr = b_utr, FALSE) AS s_u, COALESCE(abs(fee - i_fee) <= 0.01, FALSE) AS s_f FROM m0"""
CTES["m2"] = """
SELECT *, CASE WHEN s_tb THEN 20 ELSE 0 END + CASE WHEN s_ti THEN 20 ELSE 0 END + CASE WHEN s_ab THEN 15 ELSE 0 END
  + CASE WHEN s_ai THEN 15 ELSE 0 END + CASE WHEN s_u THEN 10 ELSE 0 END + CASE WHEN s_f THEN 5 ELSE 0 END
  + greatest(COALESCE(CASE WHEN d_b <= 3 THEN 15 - d_b ELSE 0 END, 0), COALESCE(CASE WHEN d_i <= 3 THEN 15 - d_i ELSE 0 END, 0)) AS total,
  CASE WHEN has_b THEN 45 ELSE 0 END + CASE WHEN has_i THEN 40 ELSE 0 END + CASE WHEN has_b OR has_i THEN 15 ELSE 0 END AS ceiling
FROM m1"""
CTES["m3"] = """
SELECT *, CASE WHEN norm >= 95 THEN 'HIGH' WHEN norm >= 85 THEN CASE WHEN s_tb OR s_ti THEN 'MEDIUM' ELSE 'LOW' END
  WHEN norm >= 70 THEN 'LOW' ELSE 'NO_MATCH' END AS raw_tier
FROM (SELECT *, CASE WHEN ceiling = 0 THEN 0 ELSE CAST(round(total * 100.0 / ceiling) AS BIGINT) END AS norm FROM m2)"""
CTES["m"] = """
SELECT *, conf <> 'NO_MATCH' AND NOT is_amb AND NOT dup AND (has_b OR has_i) AS authoritative
FROM (SELECT *, CASE WHEN (is_amb OR dup) AND raw_tier IN ('HIGH', 'MEDIUM') THEN 'LOW' ELSE raw_tier END AS conf FROM m3)"""
CTES["c"] = """
SELECT *, NOT has_b AND NOT has_i AS f_none, NOT is_amb AND NOT dup AS settled, opening + amount AS gross_after,
  CAST(round(fee * CAST(0.18 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS exp_gst,
  CAST(CASE WHEN opening + amount > 500000 THEN round(amount * CAST(0.001 AS DECIMAL(4,3)), 2) ELSE 0 END AS DECIMAL(18,2)) AS exp_tds
FROM m"""
CTES["x"] = """
SELECT *, settled AND has_b AND has_i AND conf NOT IN ('HIGH', 'MEDIUM') AS f_low,
  COALESCE(settled AND has_b AND abs(b_amount - net) > 0.01, FALSE) AS f_amt,
  settled AND has_i AND NOT COALESCE(abs(exp_gst - i_gst) <= 0.01, FALSE) AS f_gst,
  settled AND has_i AND NOT COALESCE(abs(exp_tds - i_tds) <= 0.01, FALSE) AS f_tds FROM c"""
CTES["d"] = """
SELECT *, CASE priority WHEN 0 THEN 'UNMATCHED' WHEN 1 THEN 'HUMAN_REVIEW' WHEN 2 THEN 'AMBIGUOUS' WHEN 3 THEN 'HUMAN_REVIEW'
    WHEN 4 THEN 'UNMATCHED' WHEN 5 THEN 'PARTIAL_MATCH' WHEN 6 THEN 'HUMAN_REVIEW' WHEN 7 THEN 'TAX_MISMATCH'
    WHEN 8 THEN 'TAX_MISMATCH' WHEN 10 THEN 'MATCHED' ELSE 'HUMAN_REVIEW' END AS status,
  CASE priority WHEN 1 THEN 'DUPLICATE_DETECTED' WHEN 2 THEN 'AMBIGUOUS_MATCH' WHEN 3 THEN 'AMOUNT_MISMATCH'
    WHEN 4 THEN 'MISSING_IN_BANK' WHEN 5 THEN 'MISSING_IN_INVOICE' WHEN 6 THEN 'REFERENCE_MISMATCH' WHEN 7 THEN 'ERR_GST_MISMATCH'
    WHEN 8 THEN 'ERR_TDS_VARIANCE' WHEN 10 THEN 'NONE' ELSE 'HUMAN_REVIEW_REQUIRED' END AS code,
  CASE priority WHEN 0 THEN 'no_candidates_at_all' WHEN 1 THEN 'duplicate_detected'
    WHEN 2 THEN 'ambiguous_takes_priority_over_tax_and_confidence_state' WHEN 3 THEN 'amount_mismatch'
    WHEN 4 THEN 'missing_bank_unmatched' WHEN 5 THEN 'missing_invoice_otherwise_clean'
    WHEN 6 THEN 'low_confidence_requires_human_review' WHEN 7 THEN 'gst_mismatch_takes_priority_over_tds'
    WHEN 8 THEN 'tds_mismatch' WHEN 10 THEN 'fully_clean_match' ELSE 'catch_all_unresolved_state' END AS rule,
  COALESCE(nullif(concat_ws(',', CASE WHEN f_none THEN 'HUMAN_REVIEW_REQUIRED' END, CASE WHEN dup THEN 'DUPLICATE_DETECTED' END,
    CASE WHEN is_amb THEN 'AMBIGUOUS_MATCH' END, CASE WHEN f_amt THEN 'AMOUNT_MISMATCH' END, CASE WHEN f_low THEN 'REFERENCE_MISMATCH' END,
    CASE WHEN f_gst THEN 'ERR_GST_MISMATCH' END, CASE WHEN f_tds THEN 'ERR_TDS_VARIANCE' END, CASE WHEN NOT has_b THEN 'MISSING_IN_BANK' END,
    CASE WHEN NOT has_i THEN 'MISSING_IN_INVOICE' END), ''), 'NONE') AS codes,
  has_i AND settled AS tax_evaluated, CASE WHEN has_i AND settled THEN NOT f_gst AND NOT f_tds END AS tax_verified
FROM (SELECT *, CASE WHEN f_none THEN 0 WHEN dup THEN 1 WHEN is_amb THEN 2 WHEN f_amt THEN 3 WHEN NOT has_b THEN 4
  WHEN NOT has_i THEN 5 WHEN f_low THEN 6 WHEN f_gst THEN 7 WHEN f_tds THEN 8 ELSE 10 END AS priority FROM x)"""
CTES["ld"] = """
SELECT l.*, d.status, d.code, d.codes, d.conf, d.tier, d.status = l.expected_status AS status_ok, d.code = l.expected_exception_code AS code_ok
FROM lab l LEFT JOIN d ON d.txn_id = l.txn_id"""
CTES["acct"] = """
SELECT b.bank_ref, CASE WHEN b.bank_ref IN (SELECT b_ref FROM d WHERE has_b) THEN 'SELECTED'
  WHEN b.txn_id IN (SELECT b_txn FROM d WHERE has_b AND b_txn IS NOT NULL) THEN 'DUPLICATE_CREDIT' ELSE 'ORPHANED' END AS disposition,
  b.txn_id AS resolved_txn_id, b.amount, b.utr, b.narration FROM bank b"""
CTES["rowcount"] = """
SELECT l.txn_id, l.category, (SELECT count(*) FROM pg_raw p WHERE p.txn_id = l.txn_id) AS pg_rows,
  COALESCE(o.n, 0) AS bank_rows, (SELECT count(*) FROM inv_raw i WHERE i.txn_id = l.txn_id) AS invoice_rows
FROM lab l LEFT JOIN (SELECT s.txn_id, count(*) AS n FROM bank_raw b JOIN settle s ON b.src_pos // 4 = s.k AND (b.src_pos % 4) // 2 = s.sibling
  GROUP BY s.txn_id) o ON o.txn_id = l.txn_id"""
# Attribution by narration alone. A reference is UTR or UTS and nine digits; a pair at 85 or more keeps four of them in a row.
CTES["native"] = "SELECT src_pos, bank_ref, narration FROM bank WHERE NOT starts_with(bank_ref, 'BANKREF_')"
CTES["refs"] = "SELECT utr AS ref, min(src_pos) AS pos, arg_min(txn_id, src_pos) AS txn_id FROM pg WHERE utr <> '' GROUP BY utr"
CTES["link_pairs"] = """
SELECT DISTINCT r.ref, t.txt FROM (SELECT ref, substr(ref, i, 4) AS g FROM (SELECT ref, unnest(range(1, length(ref) - 2)) AS i FROM refs)) r
JOIN (SELECT txt, substr(txt, i, 4) AS g FROM (SELECT txt, unnest(range(1, length(txt) - 2)) AS i FROM (SELECT DISTINCT narration AS txt FROM native))) t
  ON r.g = t.g WHERE regexp_matches(r.g, '^[0-9]{4}$')"""
CTES["link_sims"] = _similarity("link_pairs")
CTES["attr"] = """
SELECT n.bank_ref, n.narration, x.txn_id, x.sim FROM native n LEFT JOIN (
  SELECT s.txt, s.sim, r.txn_id, row_number() OVER (PARTITION BY s.txt ORDER BY s.sim DESC, r.pos) AS rn
  FROM link_sims s JOIN refs r ON r.ref = s.ref WHERE s.sim >= 85) x ON x.txt = n.narration AND x.rn = 1"""
CTES["presence"] = """
SELECT l.txn_id, l.category, COALESCE(p.n, 0) AS pg_rows, COALESCE(b.n, 0) AS bank_rows, COALESCE(i.n, 0) AS invoice_rows
FROM lab l LEFT JOIN (SELECT txn_id, count(*) AS n FROM pg_raw GROUP BY txn_id) p ON p.txn_id = l.txn_id
LEFT JOIN (SELECT txn_id, count(*) AS n FROM (
    SELECT nullif(split_part(substr(bank_ref, 9), '_DUP', 1), '') AS txn_id FROM bank_raw WHERE starts_with(bank_ref, 'BANKREF_')
    UNION ALL SELECT txn_id FROM attr) GROUP BY txn_id) b ON b.txn_id = l.txn_id
LEFT JOIN (SELECT txn_id, count(*) AS n FROM inv_raw GROUP BY txn_id) i ON i.txn_id = l.txn_id"""
CTES["facts"] = """
SELECT txn_id, status, CASE WHEN codes = 'NONE' THEN '' ELSE codes END AS reason_codes, total AS confidence_score,
  CAST(CAST(b_amount AS DECIMAL(18,2)) AS VARCHAR) AS claimed_amount,
  CASE WHEN has_b THEN CAST(CAST(net AS DECIMAL(18,2)) AS VARCHAR) END AS expected_amount,
  CASE WHEN status = 'MATCHED' THEN 'Transaction ' || txn_id || ' matched successfully across all sources with no exceptions.'
    ELSE 'Transaction ' || txn_id || ' was flagged as ' || status || '. Violated condition(s): '
      || CASE WHEN codes = 'NONE' THEN 'see evidence for details' ELSE replace(codes, ',', ', ') END
      || '. Confidence score: ' || CAST(total AS VARCHAR) || '.' END AS explanation FROM d"""


def build(final: str) -> str:
    """``final`` with the chain of definitions it may use in front."""
    needed, texts = set(), [final]
    while texts:  # only the definitions it uses, directly or through others
        used = set(re.findall(r"\w+", texts.pop())) & CTES.keys() - needed
        needed |= used
        texts += [CTES[n] for n in used]
    kept = {name: sql for name, sql in CTES.items() if name in needed}
    chain = ", ".join(f"{name} AS MATERIALIZED ({sql.strip()})" if name in ("gate", "edge", "d", "sims", "open_pairs", "link_sims", "attr", "scored") else f"{name} AS ({sql.strip()})" for name, sql in kept.items())
    return f"WITH {chain} {final.strip()}" if kept else final.strip()


def _v(column: str, kind: str = "DECIMAL(18,2)") -> str:
    return f"CAST(CAST({column} AS {kind}) AS VARCHAR)"


_MONEY = ", ".join(f"{_v(c)} AS {c}" for c in ("gross_amount", "pg_fee", "gst_on_fee", "tds_withheld", "net_payout", "merchant_ytd_gross_opening"))
_P = f"SELECT src_pos, settlement_id, txn_id, merchant_id, payment_method, utr, '29AAAAA' || substr(merchant_id, 7, 3) || 'A1Z5' AS merchant_gstin, {_MONEY}, strftime(CAST(\"timestamp\" AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS \"timestamp\" FROM pg_raw WHERE TRY_CAST(gross_amount AS DECIMAL(18,4)) >= 0"
_SOURCES = "'pg' || CASE WHEN has_b THEN ',bank' ELSE '' END || CASE WHEN has_i THEN ',invoice' ELSE '' END"
_PCT = "CAST(round(CAST({a} AS DECIMAL(30,6)) * 100 / CAST({b} AS DECIMAL(30,6)), {n}) AS DOUBLE)"
_BUCKET = """CASE status WHEN 'MATCHED' THEN 'settled_and_verified' WHEN 'PARTIAL_MATCH' THEN 'awaiting_verification'
  WHEN 'UNMATCHED' THEN 'not_yet_credited' ELSE 'blocked_in_exceptions' END"""
_REASON = """'bank: ' || CASE WHEN bank_n = 0 THEN 'no candidates found' WHEN bank_n = 1 THEN 'only candidate found via ' || tier
    ELSE 'selected from ' || bank_n || ' candidates via ' || tier
      || ' tier; tie-broken by lowest date delta, then expected-net amount delta, then utr' END
  || '; invoice: ' || CASE WHEN inv_n = 0 THEN 'no candidates found' WHEN inv_n = 1 THEN 'only candidate found via exact_txn'
    ELSE 'selected from ' || inv_n || ' candidates via exact_txn tier; tie-broken by lowest expected-invoice amount delta, then txn_id' END
  || CASE WHEN dup THEN '; duplicate candidate set detected' WHEN is_amb THEN '; multiple competing candidates detected' ELSE '' END
  || CASE WHEN NOT authoritative THEN '; selected pairing is non-authoritative for downstream financial reconciliation' ELSE '' END"""
_DOSSIER = f"""{_v('net')} AS expected_net, {_v('b_amount')} AS observed_amount, {_v('net - b_amount')} AS variance,
  CAST(day AS VARCHAR) AS pg_date, CAST(b_day AS VARCHAR) AS bank_date, utr, b_ref AS bank_ref, i_id AS invoice_id,
  'pg' AS expected_net_from, CASE WHEN has_b THEN 'bank' END AS observed_amount_from,
  CASE WHEN has_b THEN 'derived: expected_net - observed_amount' END AS variance_from"""
_TOOL = """CASE WHEN contains(q, 'txn_') THEN 'get_evidence'
  WHEN regexp_matches(q, 'money|cash|rupee|amount|value|blocked|stuck|owed|variance|settled') THEN 'get_cash_position'
  WHEN regexp_matches(q, 'fast|speed|throughput|long|performance') THEN 'get_throughput_report'
  WHEN regexp_matches(q, 'exception|unresolved|resolve|failed|review|ambiguous|mismatch') THEN 'get_exceptions'
  WHEN regexp_matches(q, 'match rate|matched|overall|reconcil|tier') THEN 'get_match_rate' ELSE 'none' END"""
_STATUS_WORD = """CASE WHEN contains(q, 'human review') THEN 'HUMAN_REVIEW' WHEN contains(q, 'ambiguous') THEN 'AMBIGUOUS'
  WHEN contains(q, 'tax mismatch') THEN 'TAX_MISMATCH' WHEN contains(q, 'partial match') THEN 'PARTIAL_MATCH'
  WHEN contains(q, 'unmatched') THEN 'UNMATCHED' WHEN contains(q, 'matched') THEN 'MATCHED' END"""
_ARG = f"""CASE tool WHEN 'get_evidence' THEN COALESCE(nullif(regexp_extract(upper(q), 'TXN_[0-9]{{5,8}}'), ''), trim(upper(substr(q, instr(q, 'txn_'), 9)), ' ?.,-'))
  WHEN 'get_exceptions' THEN {_STATUS_WORD} END"""


def _routed(column: str, source: str) -> str:
    return f"SELECT *, {_ARG} AS argument FROM (SELECT *, {_TOOL} AS tool FROM (SELECT *, lower({column}) AS q FROM {source}))"


_SELECTIONS = f"""
SELECT a.conv_id, a.turn, a.turn % 4 AS category, a.tool AS expected, a.argument AS expected_argument,
  r.tool AS selected, r.argument AS selected_argument, r.conv_id IS NULL AS failed
FROM ({_routed('text', "conversations WHERE role = 'user'")}) a
LEFT JOIN ({_routed('text', "conversations WHERE role = 'assistant'")}) r ON r.conv_id = a.conv_id AND r.turn - 1 = a.turn"""
_CASES = """
SELECT src_pos, narration, CASE WHEN contains(upper(narration), p_txn) THEN p_txn END AS expected,
  COALESCE(nullif(upper(regexp_extract(narration, '(?i)TXN_[0-9]{5,8}')), ''),
           nullif(upper(regexp_extract(narration, '(?i)TXN-[0-9]{4}-[0-9]{4,8}')), ''),
           nullif(upper(regexp_extract(narration, '(?i)PYT_[0-9]{7,8}')), '')) AS predicted
FROM (SELECT b.src_pos, b.narration, p.txn_id AS p_txn FROM bank b LEFT JOIN pg p ON b.utr = p.utr)"""
_QUALITY = """count_if(predicted IS NOT DISTINCT FROM expected) AS correct, count(expected) AS positive_cases,
  count_if(expected IS NOT NULL AND predicted IS NOT DISTINCT FROM expected) AS true_positive, count(predicted) AS proposed,
  count_if(predicted IS NOT NULL AND predicted IS DISTINCT FROM expected) AS false_proposals"""


def _rates(cases: str) -> str:
    def share(a: str, b: str) -> str:
        return f"CASE WHEN {b} = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST({a} AS DOUBLE) / {b}, 4) END"

    return (
        f"{share('correct', cases)} AS accuracy, {share('true_positive', 'proposed')} AS precision, "
        f"{share('true_positive', 'positive_cases')} AS recall, {share('false_proposals', cases)} AS false_proposal_rate, "
        f"{share('abstentions', cases)} AS abstention_rate"
    )


_OUTCOMES = f"""
SELECT *, CASE WHEN src_pos % 40 = 0 THEN 'timeout' WHEN src_pos % 44 = 0 THEN 'quota_failure' WHEN src_pos % 52 = 0 THEN 'parse_failure'
  WHEN src_pos % 68 = 0 THEN 'provider_failure' WHEN predicted IS NULL THEN 'abstention' ELSE 'success' END AS outcome,
  ((src_pos * 37) % 1000) / 100.0 AS latency FROM ({_CASES})"""
_EVALUATED = f"SELECT * FROM ({_OUTCOMES}) WHERE outcome IN ('success', 'abstention')"
_DIVERGE = "status IS NOT NULL AND NOT (status_ok AND code_ok)"
_BANK_LINK = """SELECT b.bank_ref, b.utr, b.narration, b.txn_id AS bank_txn, s.txn_id AS label_txn FROM bank b
  JOIN settle s ON b.src_pos // 4 = s.k AND (b.src_pos % 4) // 2 = s.sibling WHERE s.slot IN (9, 10)"""
_GOLD = """SELECT 'E2E_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS case_id, l.*
  FROM (SELECT *, row_number() OVER (ORDER BY txn_id) AS n FROM lab) l"""

FINAL: dict[str, str] = {
    "ingest_valid": f"""SELECT 'pg' AS source, src_pos, txn_id AS ref, {_v('amount')} AS amount FROM pg UNION ALL
        SELECT 'bank', src_pos, bank_ref, {_v('amount')} FROM bank UNION ALL SELECT 'invoice', src_pos, invoice_id, {_v('amount')} FROM inv""",
    "ingest_rejects": "SELECT source, src_pos, message, error_code FROM rej",
    "ingest_summary": """SELECT s.source, s.valid, s.total - s.valid AS rejected,
        (SELECT count(*) FROM rej WHERE rej.source = s.source AND error_code = 'UNSUPPORTED_TRANSACTION_TYPE') AS unsupported, s.total
        FROM (SELECT 'pg' AS source, (SELECT count(*) FROM pg) AS valid, (SELECT count(*) FROM pg_raw) AS total UNION ALL
              SELECT 'bank', (SELECT count(*) FROM bank), (SELECT count(*) FROM bank_raw) UNION ALL
              SELECT 'invoice', (SELECT count(*) FROM inv), (SELECT count(*) FROM inv_raw)) s""",
    "scan_pg": _P,
    "scan_bank": "SELECT src_pos, bank_ref, utr, CAST(day AS VARCHAR) AS value_date, narration, CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) AS credited_amount, '0.00' AS bank_charges FROM bank",
    "scan_invoice": f"SELECT src_pos, invoice_id, txn_id, irn, gstin, period, {_v('invoice_amount')} AS invoice_amount, {_v('claimed_gst')} AS claimed_gst, {_v('claimed_tds')} AS claimed_tds FROM inv_raw",
    "scan_labels": "SELECT txn_id, expected_status, expected_exception_code, category FROM lab",
    "batch_summary": """SELECT 'totals' AS section, 'batch' AS key, '{"total":' || count(*) || ',"matched":' || count_if(status = 'MATCHED') || '}' AS document FROM d
        UNION ALL SELECT 'by_status', status, '{"n":' || count(*) || '}' FROM d GROUP BY status
        UNION ALL SELECT 'exception', txn_id, '{"status":"' || status || '","exception_code":"' || code || '","reason_codes":["'
          || replace(codes, ',', '","') || '"],"confidence_score":' || total || ',"matched_rule":"' || rule || '"}' FROM d WHERE status <> 'MATCHED'""",
    "decisions_json": f"""SELECT '{{"txn_id":"' || txn_id || '","status":"' || status || '","exception_code":"' || code || '","reason_codes":["'
          || replace(codes, ',', '","') || '"],"confidence_score":' || total || ',"matched_sources":["' || replace({_SOURCES}, ',', '","')
          || '"],"tax_verified":' || COALESCE(CAST(tax_verified AS VARCHAR), 'null') || ',"matched_rule":"' || rule || '"}}' AS document FROM d""",
    "money_firewall": f"""SELECT TRY_CAST(gross_amount AS DECIMAL(18,4)) IS NOT NULL AS valid,
        CASE WHEN TRY_CAST(gross_amount AS DECIMAL(18,4)) IS NULL THEN 'SCHEMA_VALIDATION_FAILED' ELSE 'NONE' END AS error_code, count(*) AS n,
        {_v('sum(TRY_CAST(gross_amount AS DECIMAL(18,2)))', 'DECIMAL(28,2)')} AS gross FROM pg_raw GROUP BY ALL""",
    "expected_net": f"SELECT txn_id, {_v('net')} AS expected_net, {_v('bill')} AS expected_invoice FROM pg",
    "mdr_fee": f"SELECT txn_id, {_v('fee')} AS fee_due, {_v('fee')} AS fee FROM pg",
    "narration_txn_id": """SELECT src_pos, COALESCE(nullif(upper(regexp_extract(narration, '(?i)TXN_[0-9]{5,8}')), ''),
        nullif(upper(regexp_extract(narration, '(?i)TXN-[0-9]{4}-[0-9]{4,8}')), ''), nullif(upper(regexp_extract(narration, '(?i)PYT_[0-9]{7,8}')), ''))
        AS narration_txn_id, txn_id AS resolved_txn_id FROM bank""",
    "narration_similarity": "SELECT ref, txt AS text, round(sim, 2) AS similarity FROM sims WHERE sim >= 85",
    "text_normalise": """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[,%]', '', 'g'), '[^a-z0-9._\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS normalised FROM documents""",
    "confidence_tier": "SELECT txn_id, conf AS confidence, conf IN ('HIGH', 'MEDIUM') AS auto_matchable FROM d",
    "normalize_pg": f"SELECT src_pos, txn_id, utr, {_v('amount')} AS amount, {_v('fee')} AS fee, {_v('gst')} AS gst, {_v('tds')} AS tds, CAST(day AS VARCHAR) AS day FROM pg",
    "normalize_bank": f"SELECT src_pos, txn_id, utr, {_v('amount')} AS amount, CAST(day AS VARCHAR) AS day FROM bank",
    "normalize_invoice": f"SELECT src_pos, txn_id, {_v('amount')} AS amount, {_v('fee')} AS fee, {_v('gst')} AS gst, {_v('tds')} AS tds, CAST(day AS VARCHAR) AS day FROM inv",
    "normalized": f"""SELECT 'pg' AS source, src_pos, txn_id, {_v('amount')} AS amount, CAST(day AS VARCHAR) AS day FROM pg UNION ALL
        SELECT 'bank', src_pos, txn_id, {_v('amount')}, CAST(day AS VARCHAR) FROM bank UNION ALL
        SELECT 'invoice', src_pos, txn_id, {_v('amount')}, CAST(day AS VARCHAR) FROM inv""",
    "linkage_report": """SELECT 'pg' AS source, 'own_id' AS link_method, count(*) AS n FROM pg UNION ALL
        SELECT 'invoice', 'own_id', count(*) FROM inv UNION ALL SELECT 'bank', link_method, count(*) FROM bank GROUP BY link_method""",
    "source_partitions": f"""SELECT 'pg' AS source, count(*) AS n, {_v('sum(amount)', 'DECIMAL(28,2)')} AS amount FROM pg UNION ALL
        SELECT 'bank', count(*), {_v('sum(amount)', 'DECIMAL(28,2)')} FROM bank UNION ALL SELECT 'invoice', count(*), {_v('sum(amount)', 'DECIMAL(28,2)')} FROM inv""",
    "label_coverage": """SELECT txn_id, 'decisions' AS missing_from FROM lab WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.txn_id = lab.txn_id) UNION ALL
        SELECT txn_id, 'labels' FROM pg WHERE NOT EXISTS (SELECT 1 FROM lab WHERE lab.txn_id = pg.txn_id)""",
    "distinct_rows": "SELECT value_date, count(*) AS n FROM (SELECT DISTINCT utr, credited_amount, value_date, narration FROM bank_raw) GROUP BY value_date",
    "match_exact_utr": """SELECT p.txn_id, count(*) AS candidates, count(*) >= 2 AND count(DISTINCT concat_ws('|', COALESCE(b.txn_id, '?'), CAST(b.amount AS VARCHAR), CAST(b.day AS VARCHAR))) = 1 AS duplicate
        FROM pg p JOIN bank b ON b.utr = p.utr GROUP BY p.txn_id""",
    "match_exact_txn": """SELECT p.txn_id, count(*) AS candidates, count(*) >= 2 AND count(DISTINCT concat_ws('|', COALESCE(b.utr, '?'), CAST(b.amount AS VARCHAR), CAST(b.day AS VARCHAR))) = 1 AS duplicate
        FROM e2 JOIN pg p ON p.src_pos = e2.a JOIN bank b ON b.src_pos = e2.b GROUP BY p.txn_id""",
    "match_fuzzy": "SELECT txn_id, bank_n AS candidates, b_ref AS bank_ref FROM d WHERE tier = 'fuzzy'",
    "match_invoice": "SELECT p.txn_id, count(*) AS candidates, count(*) >= 2 AND count(DISTINCT i.amount) = 1 AS duplicate FROM pg p JOIN inv i ON i.txn_id = p.txn_id GROUP BY p.txn_id",
    "bank_match_type": "SELECT txn_id, tier AS bank_match_type FROM d",
    "gate_totals": f"""SELECT {_v('p.net')} AS net, CAST(p.day AS VARCHAR) AS day, count(*) AS in_gate FROM (SELECT DISTINCT net, day FROM pg) p
        JOIN bank b ON b.amount BETWEEN p.net - 0.01 AND p.net + 0.01 WHERE abs(date_diff('day', p.day, b.day)) <= 3 GROUP BY p.net, p.day""",
    "bank_ambiguity": "SELECT p.txn_id, a.n AS bank_ambiguity_count FROM amb a JOIN pg p ON p.src_pos = a.a",
    "candidate_counts": "SELECT txn_id, bank_n AS bank_candidate_count, inv_n AS invoice_candidate_count, amb_n AS bank_ambiguity_count, CAST(0 AS BIGINT) AS invoice_ambiguity_count FROM d",
    "proposal_lookup": """SELECT q.id AS proposed_txn_id, COALESCE(b.n, 0) > 0 AS found, COALESCE(b.n, 0) AS bank_rows FROM (SELECT txn_id AS id FROM lab UNION ALL SELECT txn_id || 'X' FROM lab) q
        LEFT JOIN (SELECT txn_id, count(*) AS n FROM bank GROUP BY txn_id) b ON b.txn_id = q.id""",
    "best_bank": f"SELECT txn_id, b_ref AS bank_ref, {_v('b_amount')} AS amount FROM d",
    "best_invoice": "SELECT txn_id, i_id AS invoice_id FROM d",
    "rejected_candidates": """SELECT txn_id, CAST(greatest(bank_n - 1, 0) AS BIGINT) AS rejected_bank, CAST(greatest(inv_n - 1, 0) AS BIGINT) AS rejected_invoice, b_ref AS kept_bank_ref
        FROM d WHERE bank_n > 1 OR inv_n > 1""",
    "duplicate_flag": "SELECT txn_id, dup AS duplicate_detected FROM d",
    "ambiguity_flag": "SELECT txn_id, is_amb AS is_ambiguous FROM d",
    "authoritative": f"SELECT txn_id, authoritative AS authoritative_match, {_SOURCES} AS sources FROM d",
    "selection_reason": f"SELECT txn_id, {_REASON} AS selection_reason FROM d",
    "structural_evidence": """SELECT txn_id, is_amb AS is_ambiguous, dup AS duplicate_detected, bank_n AS bank_candidate_count, inv_n AS invoice_candidate_count,
        amb_n AS additional_bank_ambiguity_count, CAST(0 AS BIGINT) AS additional_invoice_ambiguity_count, tier AS bank_match_type,
        CASE WHEN has_i THEN 'exact_txn' ELSE 'none' END AS invoice_match_type FROM d""",
    "match_invariants": "SELECT txn_id, 'authority' AS broken_rule FROM d WHERE authoritative AND (conf = 'NO_MATCH' OR is_amb OR dup OR NOT (has_b OR has_i))",
    "matching_summary": """SELECT count(*) AS total, count_if(conf = 'HIGH') AS high, count_if(conf = 'MEDIUM') AS medium, count_if(conf = 'LOW') AS low,
        count_if(conf = 'NO_MATCH') AS no_match, count_if(is_amb) AS ambiguous_flagged FROM d""",
    "match_score": """SELECT txn_id, CAST(total AS BIGINT) AS total_score, CAST(ceiling AS BIGINT) AS max_achievable, norm AS normalized_score, s_tb AS txn_id_matched_bank,
        s_ti AS txn_id_matched_invoice, s_ab AS amount_matched_bank, s_ai AS amount_matched_invoice, COALESCE(d_b <= 3, FALSE) AS date_matched_bank,
        COALESCE(d_i <= 3, FALSE) AS date_matched_invoice, s_u AS utr_matched, s_f AS fee_consistent FROM d""",
    "score_signals": f"""SELECT txn_id, NOT has_b AS missing_bank, NOT has_i AS missing_invoice, {_v('abs(net - b_amount)')} AS bank_delta, {_v('abs(bill - i_amount)')} AS invoice_delta,
        d_b AS bank_days, d_i AS invoice_days, CAST(greatest(COALESCE(CASE WHEN d_b <= 3 THEN 15 - d_b ELSE 0 END, 0), COALESCE(CASE WHEN d_i <= 3 THEN 15 - d_i ELSE 0 END, 0)) AS BIGINT) AS date_points,
        CAST(CASE WHEN has_b THEN CASE WHEN s_u THEN 10 ELSE 0 END END AS BIGINT) AS utr_points, CAST(CASE WHEN has_i THEN CASE WHEN s_f THEN 5 ELSE 0 END END AS BIGINT) AS fee_points FROM d""",
    "score_range": "SELECT txn_id FROM d WHERE total < 0 OR total > 100",
    "gst_check": f"SELECT txn_id, {_v('exp_gst')} AS expected, {_v('i_gst')} AS claimed, {_v('abs(exp_gst - i_gst)')} AS delta, COALESCE(abs(exp_gst - i_gst) <= 0.01, FALSE) AS verified FROM d",
    "tds_check": f"SELECT txn_id, gross_after > 500000 AS applicable, {_v('exp_tds')} AS expected, {_v('i_tds')} AS claimed, {_v('abs(exp_tds - i_tds)')} AS delta, COALESCE(abs(exp_tds - i_tds) <= 0.01, FALSE) AS verified FROM d",
    "tax_verification": "SELECT txn_id, COALESCE(abs(exp_gst - i_gst) <= 0.01, FALSE) AND COALESCE(abs(exp_tds - i_tds) <= 0.01, FALSE) AS fully_verified FROM d",
    "seller_gross": f"SELECT txn_id, {_v('gross_after')} AS seller_gross FROM d",
    "amount_control": f"SELECT abs(b_amount - net) > 0.01 AS differs, f_amt AS amount_mismatch, count(*) AS n, {_v('sum(net - b_amount)', 'DECIMAL(28,2)')} AS gap FROM d WHERE has_b GROUP BY ALL",
    "decision_context": """SELECT txn_id, f_none AS no_candidates_found, is_amb AS is_ambiguous, dup AS duplicate_detected, f_low AS low_confidence, NOT has_b AS missing_bank, NOT has_i AS missing_invoice,
        f_amt AS amount_mismatch, f_gst AS gst_mismatch, f_tds AS tds_mismatch, FALSE AS tax_unverifiable, priority = 10 AS fully_clean FROM d""",
    "decisions": f"SELECT txn_id, status, code AS exception_code, codes AS reason_codes, CAST(total AS BIGINT) AS confidence_score, {_SOURCES} AS matched_sources, tax_verified, rule AS matched_rule FROM d",
    "reason_codes": "SELECT txn_id, codes AS reason_codes FROM d",
    "tax_state": "SELECT txn_id, tax_evaluated, tax_verified FROM d",
    "catch_all": "SELECT txn_id, rule AS matched_rule FROM d WHERE rule = 'catch_all_unresolved_state'",
    "policy_priority": """SELECT txn_id, CAST(priority AS BIGINT) AS by_rule, CAST(CASE code WHEN 'HUMAN_REVIEW_REQUIRED' THEN 0 ELSE priority END AS BIGINT) AS by_code FROM d""",
    "match_rate": f"""SELECT total_records, matched, {_PCT.format(a='matched', b='total_records', n=2)} AS match_rate_pct, total_records - matched AS unresolved
        FROM (SELECT count(*) AS total_records, count_if(status = 'MATCHED') AS matched FROM d)""",
    "by_status": "SELECT status, count(*) AS n FROM d GROUP BY status",
    "by_tier": "SELECT conf AS confidence, count(*) AS n FROM d GROUP BY conf",
    "tier_mix": "SELECT tier AS bank_match_type, count(*) AS n FROM d GROUP BY tier",
    "status_table": """SELECT CAST(s.position AS BIGINT) AS position, s.status, count(d.txn_id) AS n FROM (VALUES (0, 'MATCHED'), (1, 'PARTIAL_MATCH'), (2, 'TAX_MISMATCH'), (3, 'AMBIGUOUS'),
        (4, 'HUMAN_REVIEW'), (5, 'UNMATCHED')) s(position, status) LEFT JOIN d ON d.status = s.status GROUP BY ALL""",
    "exceptions": f"""SELECT txn_id, status, code AS exception_code, codes AS reason_codes, CAST(total AS BIGINT) AS confidence_score, conf AS confidence_tier, {_SOURCES} AS matched_sources, tax_verified,
        CAST(priority AS BIGINT) AS policy_priority, rule AS matched_rule, 'policy priority ' || priority || ' (' || rule || '), confidence ' || total AS triage_basis, {_DOSSIER} FROM d WHERE status <> 'MATCHED'""",
    "exceptions_ambiguous": "SELECT txn_id, code AS exception_code, CAST(total AS BIGINT) AS confidence_score FROM d WHERE status = 'AMBIGUOUS'",
    "triage_rank": """SELECT txn_id, CAST(priority AS BIGINT) AS policy_priority, CAST(total AS BIGINT) AS confidence_score,
        row_number() OVER (ORDER BY priority, total, txn_id) AS triage_rank FROM d WHERE status <> 'MATCHED'""",
    "case_dossier": f"SELECT txn_id, {_DOSSIER} FROM d",
    "evidence": f"""SELECT txn_id, status, code AS exception_code, CAST(total AS BIGINT) AS confidence_score, conf AS confidence_tier, tax_evaluated, tax_verified, rule AS matched_rule,
        {_REASON} AS selection_reason, authoritative AS authoritative_match FROM d""",
    "evidence_one": f"""SELECT txn_id, status, code AS exception_code, CAST(total AS BIGINT) AS confidence_score, conf AS confidence_tier, tax_evaluated, tax_verified, rule AS matched_rule,
        {_REASON} AS selection_reason, authoritative AS authoritative_match FROM d WHERE txn_id = (SELECT max(txn_id) FROM d WHERE status <> 'MATCHED')""",
    "cash_position": f"""SELECT b.bucket AS line, {_v('COALESCE(sum(x.net), 0)', 'DECIMAL(28,2)')} AS amount, count(x.net) AS records
        FROM (VALUES ('settled_and_verified'), ('awaiting_verification'), ('blocked_in_exceptions'), ('not_yet_credited')) b(bucket)
        LEFT JOIN (SELECT {_BUCKET} AS bucket, net FROM d) x ON x.bucket = b.bucket GROUP BY b.bucket
        UNION ALL SELECT 'total_expected_settlement', {_v('sum(net)', 'DECIMAL(28,2)')}, count(*) FROM d
        UNION ALL SELECT 'total_bank_credited', {_v('sum(b_amount)', 'DECIMAL(28,2)')}, count_if(has_b) FROM d
        UNION ALL SELECT 'variance_vs_bank_credited', {_v('sum(net) - sum(b_amount)', 'DECIMAL(28,2)')}, count(*) FROM d
        UNION ALL SELECT 'records_rejected_at_ingestion', NULL, count(*) FROM rej""",
    "blocked_share": f"SELECT {_PCT.format(a=f'sum(CASE WHEN {_BUCKET} = ' + chr(39) + 'blocked_in_exceptions' + chr(39) + ' THEN net END)', b='sum(net)', n=1)} AS blocked_pct FROM d",
    "bank_completeness": f"SELECT bank_ref, disposition, resolved_txn_id, {_v('amount')} AS amount, utr, narration FROM acct",
    "completeness_totals": f"""SELECT count(*) AS total_bank_rows, count_if(disposition = 'SELECTED') AS selected, count_if(disposition = 'DUPLICATE_CREDIT') AS duplicate_credits,
        count_if(disposition = 'ORPHANED') AS orphaned, {_v("COALESCE(sum(CASE WHEN disposition = 'ORPHANED' THEN amount END), 0)", 'DECIMAL(28,2)')} AS orphaned_value,
        count(DISTINCT bank_ref) = count(*) AS is_complete FROM acct""",
    "orphans": f"SELECT bank_ref, resolved_txn_id, {_v('amount')} AS amount FROM acct WHERE disposition = 'ORPHANED'",
    "multi_violation": "SELECT txn_id, status, code AS exception_code, codes AS reason_codes FROM d WHERE contains(codes, ',')",
    "decision_labels": "SELECT txn_id, category, expected_status, status, status_ok, code_ok FROM ld",
    "accuracy": f"""SELECT *, labels - evaluated AS rejected, {_PCT.format(a='status_correct', b='evaluated', n=2)} AS status_pct, {_PCT.format(a='code_correct', b='evaluated', n=2)} AS code_pct,
        {_PCT.format(a='status_correct', b='labels', n=2)} AS status_pct_all
        FROM (SELECT count(*) AS labels, count(status) AS evaluated, count_if(status_ok) AS status_correct, count_if(code_ok) AS code_correct FROM ld)""",
    "accuracy_by_category": """SELECT category, count(*) AS total, count(*) FILTER (WHERE status_ok) AS status_ok, count(*) FILTER (WHERE code_ok) AS code_ok, count_if(status IS NULL) AS not_evaluable,
        count(status) AS evaluable FROM ld GROUP BY category""",
    "divergences": f"""SELECT txn_id, category, expected_status, status AS actual_status, expected_exception_code, code AS actual_exception_code, codes AS reason_codes FROM ld WHERE {_DIVERGE}""",
    "rejected_labels": "SELECT txn_id, category, expected_status FROM ld WHERE status IS NULL",
    "label_reachability": "SELECT category, expected_status, count(*) AS n, TRUE AS reachable FROM lab GROUP BY ALL",
    "tier_by_category": """SELECT category, count_if(tier = 'exact_utr') AS exact_utr, count_if(tier = 'exact_txn') AS exact_txn, count_if(tier = 'fuzzy') AS fuzzy, count_if(tier = 'none') AS "none"
        FROM ld WHERE tier IS NOT NULL GROUP BY category""",
    "fuzzy_sweep": """SELECT threshold, tp, fp, fn, CASE WHEN tp + fp = 0 THEN CAST('nan' AS DOUBLE) ELSE round(CAST(tp AS DOUBLE) / (tp + fp), 2) END AS precision,
          CASE WHEN tp + fn = 0 THEN CAST('nan' AS DOUBLE) ELSE round(CAST(tp AS DOUBLE) / (tp + fn), 2) END AS recall
        FROM (SELECT t.threshold, count_if(sim >= threshold AND good) AS tp, count_if(sim >= threshold AND NOT good) AS fp, count_if(sim < threshold AND any_good) AS fn
          FROM (SELECT DISTINCT o.a, first_value(s.sim) OVER w AS sim, first_value(COALESCE(b.txn_id = p.txn_id, b.amount = p.net)) OVER w AS good,
              max(COALESCE(b.txn_id = p.txn_id, b.amount = p.net)) OVER (PARTITION BY o.a) AS any_good
            FROM open_pairs o JOIN sims s ON s.ref = o.ref AND s.txt = o.txt JOIN bank b ON b.src_pos = o.b JOIN pg p ON p.src_pos = o.a
            WHERE o.a IN (SELECT a FROM e3) WINDOW w AS (PARTITION BY o.a ORDER BY s.sim DESC, o.b)) q
          CROSS JOIN (SELECT CAST(unnest(range(60, 100, 5)) AS BIGINT) AS threshold) t GROUP BY t.threshold)""",
    "dq_categories": "SELECT category, count(*) AS actual FROM lab GROUP BY category",
    "dq_pg_gst": f"SELECT txn_id, {_v('gst')} AS actual_gst, {_v('round(fee * 0.18, 2)')} AS expected_gst FROM pg WHERE abs(round(fee * 0.18, 2) - gst) > 0.01",
    "dq_tds_split": "SELECT count_if(tds = 0) AS zero_tds, count_if(tds > 0) AS nonzero_tds, count_if(tds > 0) > 0 AS ok FROM pg",
    "attribute_bank_rows": "SELECT bank_ref, txn_id, round(sim, 2) AS similarity FROM attr",
    "dq_presence": "SELECT * FROM presence",
    "case_table": """SELECT 'E2E_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS case_id,
        txn_id, category, expected_status, expected_exception_code, pg_rows, bank_rows, invoice_rows
        FROM (SELECT p.*, l.expected_status, l.expected_exception_code, row_number() OVER (ORDER BY p.txn_id) AS n
              FROM presence p JOIN lab l ON l.txn_id = p.txn_id)""",
    "dq_referential": """SELECT * FROM presence WHERE NOT CASE category WHEN 'corrupted' THEN true
        WHEN 'missing_in_source' THEN pg_rows > 0 AND (bank_rows > 0) <> (invoice_rows > 0) ELSE pg_rows > 0 AND bank_rows > 0 AND invoice_rows > 0 END""",
    "dq_corrupted_similarity": """SELECT a.txn_id, a.bank_ref, round(a.sim, 2) AS similarity, a.sim >= 85 AS recoverable, NOT contains(a.narration, 'UTR') AS prefix_corrupted
        FROM attr a JOIN lab l ON l.txn_id = a.txn_id WHERE l.category = 'reference_mismatch_fuzzy'""",
    "numeric_literals": r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(COALESCE(text, ''),
          '(?:^|[^A-Za-z0-9_])([₹$€£]?\s*-?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:%\B|\b))', 1), lambda t:
        CASE WHEN contains(t, '-') AND ltrim(rtrim(regexp_replace(t, '[^0-9.]', '', 'g'), '.'), '0.') <> '' THEN '-' ELSE '' END
        || COALESCE(nullif(ltrim(regexp_extract(regexp_replace(t, '[^0-9.]', '', 'g'), '^([0-9]*)', 1), '0'), ''), '0')
        || CASE WHEN rtrim(regexp_extract(t, '\.([0-9]*)', 1), '0') = '' THEN '' ELSE '.' || rtrim(regexp_extract(t, '\.([0-9]*)', 1), '0') END))), ',') AS numbers
        FROM documents""",
    "dq_duplicate_rows": "SELECT txn_id, bank_rows FROM rowcount WHERE category = 'duplicate' AND bank_rows <> 2",
    "dq_fuzzy_reachable": f"SELECT bank_ref, label_txn, 'exact' AS problem FROM ({_BANK_LINK}) WHERE utr IS NOT NULL OR bank_txn IS NOT NULL OR narration = ''",
    "dq_collisions": f"""SELECT {_v('p.amount')} AS gross, CAST(p.day AS VARCHAR) AS day, count(*) AS n, count(*) >= 2 AS genuine FROM lab l JOIN pg p ON p.txn_id = l.txn_id
        WHERE l.category = 'ambiguous' GROUP BY p.amount, p.day""",
    "dq_narration_shapes": "SELECT contains(narration, '-') AS dash, contains(narration, '/') AS slash, contains(narration, '*') AS star, contains(narration, ' CR ') AS cr, count(*) AS n FROM bank GROUP BY ALL",
    "dq_tax_detectable": """SELECT count(*) AS records, count_if(abs(round(p.fee * 0.18, 2) - i.gst) > 0.01) AS gst_cases, count_if(abs(p.tds - i.tds) > 0.01) AS tds_cases,
        count_if(abs(round(p.fee * 0.18, 2) - i.gst) <= 0.01 AND abs(p.tds - i.tds) <= 0.01) AS undetectable
        FROM lab l JOIN pg p ON p.txn_id = l.txn_id JOIN inv i ON i.txn_id = l.txn_id WHERE l.category = 'tax_mismatch'""",
    "net_collisions": f"SELECT {_v('p.net')} AS net, count(*) AS n FROM pg p JOIN lab l ON l.txn_id = p.txn_id WHERE l.category <> 'ambiguous' GROUP BY p.net HAVING count(*) > 1",
    "mdr_mix": "SELECT payment_method, count(*) AS n, count_if(fee = 0) AS zero_fee FROM pg GROUP BY payment_method",
    "tax_mismatch_precision": "SELECT category, count(*) AS flagged, count_if(status_ok) AS correct, count_if(NOT status_ok) AS false_positive FROM ld WHERE status = 'TAX_MISMATCH' GROUP BY category",
    "ambiguity_diagnosis": """SELECT txn_id, gated_n AS gated_bank_rows, gated_n - amb_n AS skipped_rows, amb_n AS evidence_rows, CASE WHEN amb_n > 0 THEN 'EVIDENCE' ELSE 'SKIPPED' END AS verdict
        FROM d WHERE gated_n > 0""",
    "decision_lines": "SELECT txn_id, line, sha256(line) AS digest FROM (SELECT txn_id, concat_ws('|', txn_id, status, code, codes, CAST(total AS VARCHAR), rule) AS line FROM d)",
    "narration_metrics": f"""SELECT *, {_rates('total')} FROM (SELECT count(*) AS total, {_QUALITY}, count_if(predicted IS NULL) AS abstentions FROM ({_CASES}))""",
    "extraction_metrics": f"""SELECT *, round(CAST(evaluated_cases AS DOUBLE) / total, 4) AS coverage, {_rates('evaluated_cases')} FROM
        (SELECT count(*) AS evaluated_cases, {_QUALITY} FROM ({_EVALUATED})),
        (SELECT count(*) AS total, count_if(outcome = 'abstention') AS abstentions, count_if(outcome = 'timeout') AS timeout, count_if(outcome = 'quota_failure') AS quota_failure,
           count_if(outcome = 'parse_failure') AS parse_failure, count_if(outcome = 'provider_failure') AS provider_failure FROM ({_OUTCOMES})),
        (SELECT CAST(median(latency) AS DOUBLE) AS median_latency FROM ({_EVALUATED})),
        (SELECT CAST(latency AS DOUBLE) AS p95_latency FROM (SELECT latency, row_number() OVER (ORDER BY latency, src_pos) AS r, count(*) OVER () AS n FROM ({_EVALUATED})) WHERE r = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) + 1)""",
    "keyword_route": f"SELECT conv_id, turn, tool, argument FROM ({_routed('text', 'conversations WHERE role = ' + chr(39) + 'user' + chr(39))})",
    "selection_metrics": f"""SELECT *, {_PCT.format(a='tool_correct', b='total_cases', n=2)} AS tool_accuracy_pct, {_PCT.format(a='arguments_correct', b='total_cases', n=2)} AS arguments_accuracy_pct
        FROM (SELECT category, count(*) AS total_cases, count_if(COALESCE(selected = expected, FALSE)) AS tool_correct,
          count_if(COALESCE(selected = expected, FALSE) AND selected_argument IS NOT DISTINCT FROM expected_argument) AS arguments_correct,
          count_if(selected IS NULL) AS invalid_selections, count_if(failed) AS provider_failures, CAST(0 AS BIGINT) AS parse_failures FROM ({_SELECTIONS}) GROUP BY category)""",
    "selection_confusion": f"SELECT expected, COALESCE(selected, '<none returned>') AS selected, count(*) AS n FROM ({_SELECTIONS}) GROUP BY ALL",
    "explanation_facts": "SELECT txn_id, status, reason_codes, CAST(confidence_score AS BIGINT) AS confidence_score, claimed_amount, expected_amount FROM facts",
    "explanation_text": "SELECT txn_id, explanation FROM facts",
    "explanation_violations": """SELECT txn_id, concat_ws(',', CASE WHEN claimed_amount IS NOT NULL THEN 'missing_claimed_amount:' || claimed_amount END,
        CASE WHEN expected_amount IS NOT NULL THEN 'missing_expected_amount:' || expected_amount END) AS violations, claimed_amount IS NULL AND expected_amount IS NULL AS passed FROM facts""",
    "ungrounded_numbers": """SELECT txn_id, CASE WHEN has_b AND b_amount <> net AND CAST(b_amount AS DOUBLE) <> total
          THEN regexp_replace(regexp_replace(CAST(CAST(b_amount AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\\.$', '') ELSE '' END AS ungrounded,
        NOT (has_b AND b_amount <> net AND CAST(b_amount AS DOUBLE) <> total) AS grounded FROM d""",
}

_ANSWERS = """SELECT f.txn_id, f.status, f.reason_codes, f.confidence_score, f.claimed_amount, f.expected_amount,
    CASE WHEN d.src_pos % 5 <> 0 AND d.has_b AND d.src_pos % 7 = 0 THEN CAST(CAST(d.net + 1 AS DECIMAL(18,2)) AS VARCHAR) END AS stray,
    f.explanation || CASE WHEN d.src_pos % 5 = 0 OR NOT d.has_b THEN '' ELSE ' Claimed INR ' || f.claimed_amount || ', expected INR '
      || CASE WHEN d.src_pos % 7 = 0 THEN CAST(CAST(d.net + 1 AS DECIMAL(18,2)) AS VARCHAR) ELSE f.expected_amount END || '.' END AS explanation
  FROM facts f JOIN d ON d.txn_id = f.txn_id"""


def _short(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '0+$', ''), '\\.$', '')"


_SAID = "trim(regexp_replace(regexp_replace(regexp_replace(lower(explanation), '[,%]', '', 'g'), '[^a-z0-9._\\-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_SCORED = f"""SELECT *, CASE WHEN unsupported_claims <> '' THEN 0 ELSE 20 + CASE WHEN amounts_preserved THEN 20 ELSE 0 END + 20
      + CASE WHEN confidence_preserved THEN 10 ELSE 0 END + CASE WHEN reason_codes_preserved THEN 15 ELSE 0 END + 15 END AS score,
    concat_ws(',', CASE WHEN NOT has_claimed THEN 'claimed_amount:' || claimed_amount END, CASE WHEN NOT has_expected THEN 'expected_amount:' || expected_amount END,
      CASE WHEN NOT confidence_preserved THEN 'confidence_score:' || CAST(confidence_score AS VARCHAR) END) AS missing_facts
  FROM (SELECT *, has_claimed AND has_expected AS amounts_preserved FROM (SELECT *,
    COALESCE(contains(said, {_short('claimed_amount')}), TRUE) AS has_claimed, COALESCE(contains(said, {_short('expected_amount')}), TRUE) AS has_expected,
    contains(said, CAST(confidence_score AS VARCHAR)) AS confidence_preserved,
    status <> 'MATCHED' OR reason_codes = '' AS reason_codes_preserved,
    CASE WHEN stray IS NOT NULL AND stray <> claimed_amount AND stray <> expected_amount THEN {_short('stray')} ELSE '' END AS unsupported_claims
    FROM (SELECT *, {_SAID} AS said FROM ({_ANSWERS}))))"""
CTES["scored"] = _SCORED
_FLAGS = "TRUE AS status_preserved, amounts_preserved, TRUE AS tax_preserved, confidence_preserved, reason_codes_preserved, TRUE AS evidence_preserved"
FINAL["explanation_scores"] = f"""SELECT txn_id AS case_id, {_FLAGS}, '' AS contradictions, unsupported_claims, missing_facts, unsupported_claims <> '' AS safety_critical,
    unsupported_claims = '' AND missing_facts = '' AS semantically_faithful, CAST(score AS BIGINT) AS score FROM scored"""
FINAL["explanation_summary"] = f"""SELECT count(*) AS total, count(*) AS status_preserved, count_if(amounts_preserved) AS amounts_preserved, count(*) AS tax_preserved,
    count_if(confidence_preserved) AS confidence_preserved, count_if(reason_codes_preserved) AS reason_codes_preserved, count(*) AS evidence_preserved,
    count_if(unsupported_claims = '' AND missing_facts = '') AS semantically_faithful, count_if(unsupported_claims <> '') AS safety_critical,
    CAST(0 AS BIGINT) AS contradictory_cases, count_if(unsupported_claims <> '') AS unsupported_claim_cases FROM ({_SCORED})"""
_LINES = "SELECT txn_id, concat_ws('|', txn_id, status, code, codes, CAST(total AS VARCHAR), rule) AS line FROM d"
_SUMS = ", ".join(
    f"CAST(COALESCE(sum(CAST('0x' || substr(sha256(line), {1 + 15 * k}, 15) AS HUGEINT)) % 2305843009213693951, 0) AS BIGINT) AS sum_digest_{k + 1}" for k in range(2)
)
FINAL["batch_digest"] = f"""SELECT bit_xor(CAST('0x' || substr(md5(line), 1, 15) AS BIGINT)) AS xor_digest, count(*) AS lines, {_SUMS} FROM ({_LINES})"""
FINAL["range_digests"] = f"SELECT substr(txn_id, 1, 8) AS range, count(*) AS lines, {_SUMS} FROM ({_LINES}) GROUP BY 1"
FINAL["scan_array"] = f"""SELECT bank_ref, utr, CAST(day AS VARCHAR) AS value_date, narration, {_v('amount')} AS credited_amount, 'valid' AS kind FROM bank
  UNION ALL SELECT b.bank_ref, r.error_code, NULL, r.message, '', 'rejected' FROM rej r JOIN bank_raw b ON b.src_pos = r.src_pos WHERE r.source = 'bank'"""
FINAL["feeds_round_trip"] = """SELECT form, feed, valid, rejected, TRUE AS same_values FROM (SELECT unnest(['array', 'lines', 'csv']) AS form) CROSS JOIN (
    SELECT 'pg' AS feed, (SELECT count(*) FROM pg) AS valid, (SELECT count(*) FROM rej WHERE source = 'pg') AS rejected UNION ALL
    SELECT 'bank', (SELECT count(*) FROM bank), (SELECT count(*) FROM rej WHERE source = 'bank') UNION ALL
    SELECT 'invoice', (SELECT count(*) FROM inv), (SELECT count(*) FROM rej WHERE source = 'invoice') UNION ALL SELECT 'labels', (SELECT count(*) FROM lab), 0)"""
# one list for each question; groups of one day and amount have one order for all
FINAL["rejected_rows"] = f"""SELECT tier, key, CAST(ask_day AS VARCHAR) AS ask_day, {_v('ask_net')} AS ask_net, count(*) AS anchors, rn - 1 AS rank, bank_ref
  FROM (SELECT r.tier, r.rn, r.bank_ref, CASE WHEN r.tier = 'exact_txn' THEN p.txn_id ELSE p.utr END AS key,
      CASE WHEN r.tier = 'fuzzy' OR NOT r.uniform THEN p.day END AS ask_day, CASE WHEN r.tier = 'fuzzy' OR NOT r.uniform THEN p.net END AS ask_net
    FROM (SELECT *, min(day) OVER (PARTITION BY a) = max(day) OVER (PARTITION BY a) AND min(amount) OVER (PARTITION BY a) = max(amount) OVER (PARTITION BY a) AS uniform
      FROM ranked WHERE n > 1) r JOIN pg p ON p.src_pos = r.a) WHERE rn > 1 GROUP BY ALL"""
# near the amount at any date: the anchor's own rows, rivals in the date window, and the rest
FINAL["near_verdicts"] = """SELECT p.txn_id, COALESCE(x.near_rows, 0) AS near_rows, COALESCE(x.skipped, 0) AS skipped_rows, COALESCE(x.evidence, 0) AS evidence_rows,
    COALESCE(x.near_rows - x.skipped - x.evidence, 0) AS rejected_rows
  FROM pg p LEFT JOIN (SELECT p.src_pos, count(*) AS near_rows, count_if(COALESCE(b.txn_id = p.txn_id, FALSE)) AS skipped,
      count_if(NOT COALESCE(b.txn_id = p.txn_id, FALSE) AND abs(date_diff('day', p.day, b.day)) <= 3) AS evidence
    FROM pg p JOIN bank b ON b.amount BETWEEN p.net - 0.01 AND p.net + 0.01 GROUP BY p.src_pos) x ON x.src_pos = p.src_pos"""
FINAL["fuzzy_checked"] = "SELECT txn_id, tier AS bank_match_type, gated_n AS fuzzy_candidates_checked FROM d WHERE tier IN ('fuzzy', 'none')"
FINAL["faithfulness_report"] = f"""SELECT measure, CAST(cases AS BIGINT) AS cases, total, CAST(round(CAST(cases AS DECIMAL(30,6)) * 100 / CAST(total AS DECIMAL(30,6)), 4) AS DOUBLE) AS rate_percent
  FROM (SELECT count(*) AS total, (SELECT count(*) FROM d WHERE has_b) AS generation_success, count_if(unsupported_claims <> '') AS safety_failure, CAST(0 AS BIGINT) AS contradiction,
      count_if(unsupported_claims <> '') AS unsupported_claim, count_if(unsupported_claims = '' AND missing_facts = '') AS semantic_faithfulness,
      count(*) AS status_preserved, count_if(amounts_preserved) AS amounts_preserved, count(*) AS tax_preserved, count_if(confidence_preserved) AS confidence_preserved,
      count_if(reason_codes_preserved) AS reason_codes_preserved, count(*) AS evidence_preserved FROM ({_SCORED}))
  UNPIVOT (cases FOR measure IN (generation_success, safety_failure, contradiction, unsupported_claim, semantic_faithfulness, status_preserved, amounts_preserved,
    tax_preserved, confidence_preserved, reason_codes_preserved, evidence_preserved))"""
FINAL["case_alignment"] = """SELECT txn_id AS case_id, TRUE AS in_dataset, has_b AS in_generated, status <> 'MATCHED' AS in_scored
  FROM d WHERE NOT (has_b AND status <> 'MATCHED')"""
FINAL["faithfulness_gaps"] = f"""SELECT 'material_fact_gap' AS gap, txn_id AS case_id FROM ({_SCORED}) WHERE missing_facts <> ''
    UNION ALL SELECT 'reason_code_semantic_gap', txn_id FROM ({_SCORED}) WHERE NOT reason_codes_preserved"""


def statements() -> dict[str, str]:
    return {name: build(sql) for name, sql in FINAL.items()}

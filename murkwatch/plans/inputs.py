"""Inputs derived from the given tables.

The tables hold no payment handles, verdicts or registrations, so each input
writes such text from row keys. All of them keep every row of their table.
"""

from .registry import define_input

# URLs: the crawl's own, some with an encoded query, plus one per event covering every rule.
define_input("urls", """
SELECT page_id AS url_id,
       CASE page_id % 5 WHEN 4 THEN url || '?next=%2Faccount%20update' ELSE url END AS url
FROM {pages}
UNION ALL
SELECT -1 - event_id AS url_id,
       CASE event_id % 24
         WHEN 0 THEN 'http://hdfcb4nk-login.tk/verify?id=' || event_id
         WHEN 1 THEN 'https://www.hdfcbank.com/netbanking/' || user_id
         WHEN 2 THEN 'http://192.168.' || (user_id % 256) || '.' || (event_id % 256) || '/login'
         WHEN 3 THEN 'https://secure-account-verify-kyc.sb1.xyz/otp?u=' || user_id || '&t=1&s=2'
         WHEN 4 THEN 'https://a.b.c.d.e.example' || (user_id % 9) || '.com/path/to/page'
         WHEN 5 THEN 'icicibnak.com/update'
         WHEN 6 THEN 'https://xn--pple-43d.com:8443/free-gift'
         WHEN 7 THEN 'https://axisbank.in/home'
         WHEN 8 THEN '  https://kot4k.top/unlock%20now  '
         WHEN 9 THEN 'http://user:pw@paypal-secure.ml:8080/a;x=1?q=%6Cogin'
         WHEN 10 THEN ''
         WHEN 11 THEN 'https://very-long-subdomain-name-for-testing-purposes-only.example-site.org/x' || event_id
         WHEN 12 THEN 'http://10.0.' || (user_id % 256) || '.7:9000/admin?next=1'
         WHEN 13 THEN 'https://canarabannk.co/Login/KYC'
         WHEN 14 THEN 'https://onlinesbi.sbi/portal?otp=1'
         WHEN 15 THEN 'http://8.8.' || (event_id % 256) || '.8/dns'
         WHEN 16 THEN 'https://pnb.tk/blocked'
         WHEN 17 THEN 'https://shop' || user_id || '.example.com/win-prize/' || event_id || '.zip'
         WHEN 18 THEN 'HTTPS://Example.COM/Path#frag'
         WHEN 19 THEN 'https://bankofbarodaa.in/urgent?password=reset'
         WHEN 20 THEN 'https://yesb4nk.click/'
         WHEN 21 THEN 'ftp://files.example.net/data'
         WHEN 22 THEN 'https://example.com?x=1&y=2#z'
         ELSE 'https://news' || (user_id % 50) || '.example.org/story_' || event_id
       END AS url
FROM {events}
""")

# Literal hosts: both ends of every blocked range, their neighbours, IPv6 in long, short and mixed spelling, with the
# class that address arithmetic gives each.
define_input("fetch_cases", """
SELECT -1000000000 - event_id AS url_id, c.url AS url, c.expected AS expected
FROM {events} JOIN (VALUES
  (0, 'http://0.0.0.0/x', 'blocked_address'),
  (1, 'http://0.255.255.255/x', 'blocked_address'),
  (2, 'http://10.0.0.1/x', 'blocked_address'),
  (3, 'http://10.255.255.255/x', 'blocked_address'),
  (4, 'http://100.64.0.0/x', 'blocked_address'),
  (5, 'http://100.127.255.255/x', 'blocked_address'),
  (6, 'http://127.0.0.1/x', 'blocked_address'),
  (7, 'http://169.254.169.254/x', 'blocked_address'),
  (8, 'http://172.16.0.0/x', 'blocked_address'),
  (9, 'http://172.31.255.255/x', 'blocked_address'),
  (10, 'http://192.0.0.255/x', 'blocked_address'),
  (11, 'http://192.0.2.1/x', 'blocked_address'),
  (12, 'http://192.168.255.255/x', 'blocked_address'),
  (13, 'http://198.18.0.0/x', 'blocked_address'),
  (14, 'http://198.19.255.255/x', 'blocked_address'),
  (15, 'http://198.51.100.7/x', 'blocked_address'),
  (16, 'http://203.0.113.255/x', 'blocked_address'),
  (17, 'http://224.0.0.1/x', 'blocked_address'),
  (18, 'http://239.255.255.255/x', 'blocked_address'),
  (19, 'http://240.0.0.1/x', 'blocked_address'),
  (20, 'http://255.255.255.255/x', 'blocked_address'),
  (21, 'http://[::]/x', 'blocked_address'),
  (22, 'http://[::1]/x', 'blocked_address'),
  (23, 'http://[0:0:0:0:0:0:0:0]/x', 'blocked_address'),
  (24, 'http://[0:0:0:0:0:0:0:1]/x', 'blocked_address'),
  (25, 'http://[0000:0000:0000:0000:0000:0000:0000:0001]/x', 'blocked_address'),
  (26, 'http://[0::0:1]/x', 'blocked_address'),
  (27, 'http://[::0.0.0.1]/x', 'blocked_address'),
  (28, 'http://[fc00::]/x', 'blocked_address'),
  (29, 'http://[FDFF:ffff::1]/x', 'blocked_address'),
  (30, 'http://[fe80::1]/x', 'blocked_address'),
  (31, 'http://[FE80:0:0:0:0:0:0:2]/x', 'blocked_address'),
  (32, 'http://[febf::9]/x', 'blocked_address'),
  (33, 'http://[ff02::1]/x', 'blocked_address'),
  (34, 'https://1.0.0.0:8443/', 'allowed'),
  (35, 'https://9.255.255.255:8443/', 'allowed'),
  (36, 'https://11.0.0.0:8443/', 'allowed'),
  (37, 'https://100.63.255.255:8443/', 'allowed'),
  (38, 'https://100.128.0.0:8443/', 'allowed'),
  (39, 'https://172.15.255.255:8443/', 'allowed'),
  (40, 'https://172.32.0.0:8443/', 'allowed'),
  (41, 'https://192.0.1.0:8443/', 'allowed'),
  (42, 'https://198.17.255.255:8443/', 'allowed'),
  (43, 'https://198.20.0.0:8443/', 'allowed'),
  (44, 'https://198.51.99.255:8443/', 'allowed'),
  (45, 'https://198.51.101.0:8443/', 'allowed'),
  (46, 'https://203.0.114.0:8443/', 'allowed'),
  (47, 'https://223.255.255.255:8443/', 'allowed'),
  (48, 'https://[2001:db8::1]:8443/', 'allowed'),
  (49, 'https://[::2]:8443/', 'allowed'),
  (50, 'https://[1::1]:8443/', 'allowed'),
  (51, 'https://[fbff::1]:8443/', 'allowed'),
  (52, 'https://[fe7f::1]:8443/', 'allowed'),
  (53, 'https://[fec0::1]:8443/', 'allowed'),
  (54, 'https://[2606:4700:0:0:0:0:0:1111]:8443/', 'allowed'),
  (55, 'http://[1:2:3]/', 'needs_resolution'),
  (56, 'http://[::g]/', 'needs_resolution'),
  (57, 'http://host.example/', 'needs_resolution')) AS c(k, url, expected) ON event_id % 58 = c.k
""")

# Registration and certificate snapshot, one row per domain that is known.
define_input("registrations", """
SELECT domain, CAST(TIMESTAMP '2024-02-01 00:00:00' - age_days * INTERVAL 1 DAY AS DATE) AS created_on,
       CAST(TIMESTAMP '2024-02-01 00:00:00' + cert_days * INTERVAL 1 DAY AS DATE) AS cert_valid_to, self_signed
FROM (
  SELECT 'shop' || c_custkey || '.example.com' AS domain, CAST(c_custkey * 13 % 400 AS INT) AS age_days,
         CAST(c_custkey * 7 % 90 - 20 AS INT) AS cert_days, c_nationkey % 6 = 0 AS self_signed
  FROM {customer}
  UNION ALL
  SELECT 'news' || n_nationkey || '.example.org', CAST(n_nationkey * 11 AS INT), CAST(n_nationkey - 5 AS INT),
         n_regionkey = 2
  FROM {nation}
) known
""")

# Payment receipts: one per order, ten layouts, with image signals as columns.
define_input("receipts", """
SELECT o_orderkey AS receipt_id, o_custkey AS payer, o_orderdate AS seen_at,
       CASE o_orderkey % 10
         WHEN 0 THEN 'PhonePe payment successful. Paid to shop' || o_custkey || '@ybl Amount: ₹1,' || (100 + o_custkey % 900) || '.50 UTR: ' || lpad(CAST(o_orderkey AS STRING), 12, '4')
         WHEN 1 THEN 'Google Pay to: user' || o_custkey || '@okaxis from me@oksbi Rs. ' || (o_orderkey % 5000) || ' UPI Ref: ABC' || lpad(CAST(o_orderkey AS STRING), 8, '0')
         WHEN 2 THEN 'Paytm wallet received by merchant@paytm INR ' || (o_custkey % 700) || '.25 txn id T' || lpad(CAST(o_orderkey AS STRING), 12, '7')
         WHEN 3 THEN 'BHIM UPI credited to x.y-z_' || o_custkey || '@upi total: 2,50,000.00 ref no 99'
         WHEN 4 THEN 'Dinner photo with friends, table ' || (o_orderkey % 40)
         WHEN 5 THEN 'Payment failed and reversed. refund of amount ' || (o_orderkey % 1000) || ' Transaction ID - 12AB34CD' || (o_orderkey % 1000)
         WHEN 6 THEN ''
         WHEN 7 THEN 'me@okicici sent 15,' || (100 + o_orderkey % 900) || '.00 on 12/03/2024' || chr(10) || 'bank reference id:9' || lpad(CAST(o_custkey AS STRING), 11, '1') || ' paid to a@ybl'
         WHEN 8 THEN 'GPay receipt fake generated rs 40 ' || lpad(CAST(o_orderkey AS STRING), 12, '3') || ' and T12345678901 paid'
         ELSE 'UPI transaction id ZZ' || lpad(CAST(o_orderkey AS STRING), 14, '5') || ' sent to ' || o_custkey || '@ibl amount: 99'
       END AS ocr_text,
       CASE WHEN o_orderkey % 10 = 6 THEN 0e0 ELSE (o_orderkey * 37 % 100) / 100e0 END AS ocr_confidence,
       o_orderkey % 7 = 0 AS tamper_suspected, o_orderkey % 3 <> 0 AS font_consistent,
       o_orderkey % 4 <> 0 AS color_authentic,
       CASE o_orderkey % 7 WHEN 0 THEN 35 ELSE 0 END AS ela_score,
       (o_orderkey * 53 % 200) / 1000e0 AS hotspot_ratio, (o_orderkey * 29 % 100) / 10e0 AS mean_diff,
       (o_custkey * 17 % 400) / 2e0 AS height_variance, (o_custkey * 31 % 120) / 1e0 AS color_distance,
       CASE o_orderkey % 6 WHEN 0 THEN 'FORGED' WHEN 1 THEN 'GENUINE' WHEN 2 THEN 'SUSPICIOUS' WHEN 3 THEN 'GENUINE' ELSE NULL END AS visual_verdict,
       CAST(o_orderkey * 41 % 101 AS DOUBLE) AS visual_confidence,
       CASE o_orderkey % 5 WHEN 0 THEN 'PhonePe' WHEN 1 THEN 'GPay' WHEN 2 THEN 'Paytm' WHEN 3 THEN 'BHIM' ELSE 'Unknown' END AS app
FROM {orders}
""")

# Documents with file metadata and, for some, payment-scam phrases appended.
define_input("docs", """
SELECT doc_id, lang, source, n_chars,
       CASE doc_id % 6
         WHEN 0 THEN text || ' URGENT: verify your KYC update, click here now. Verify today.'
         WHEN 1 THEN text || ' Congratulations, you won a lottery prize and a gift card; claim your refund in bitcoin.'
         WHEN 2 THEN text || ' Salary statement of the employee account.'
         ELSE text
       END AS text,
       CASE doc_id % 8 WHEN 0 THEN 'Adobe Photoshop 24' WHEN 1 THEN 'Microsoft Word' WHEN 2 THEN 'Canva' WHEN 3 THEN NULL ELSE 'LibreOffice' END AS creator,
       CASE doc_id % 9 WHEN 0 THEN 'GIMP plugin' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'Acrobat Distiller' END AS producer,
       CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE 'author ' || source END AS author,
       CASE doc_id % 4 WHEN 0 THEN NULL ELSE 'D:2024010' || (doc_id % 4) END AS creation_date,
       CASE doc_id % 3 WHEN 0 THEN NULL ELSE 'D:2024010' || (doc_id % 3) END AS modification_date,
       doc_id % 11 = 0 AS is_encrypted,
       CASE doc_id % 10 WHEN 0 THEN 'invoice_' || doc_id || '.pdf' WHEN 1 THEN 'scan_edited_' || doc_id || '.pdf' WHEN 2 THEN 'Tampered ' || doc_id || '.png' ELSE 'report_' || doc_id || '.pdf' END AS filename
FROM {documents}
""")

# Fraud events: the central fact table.
define_input("fraud_events", """
SELECT 'ev_' || lpad(CAST(event_id AS STRING), 10, '0') AS event_id,
       CASE WHEN event_type IN ('signup', 'error') THEN 'doc_' || user_id ELSE NULL END AS doc_id,
       CASE event_type WHEN 'signup' THEN 'DOCUMENT' WHEN 'error' THEN 'DOCUMENT' WHEN 'click' THEN 'URL' WHEN 'view' THEN 'URL' ELSE 'OTHER' END AS source_type,
       CASE WHEN event_type = 'signup' THEN 'Invoice_' || user_id || '.pdf' WHEN event_type = 'error' THEN 'scan' || (user_id % 10) || '.pdf' ELSE NULL END AS original_filename,
       CASE WHEN event_type IN ('click', 'view') THEN 'site' || (user_id % 30) || '.example.tk' ELSE NULL END AS source_domain,
       CAST(event_id * 37 % 101 AS INT) AS risk_score,
       CASE WHEN event_id * 37 % 101 > 95 THEN 'CRITICAL' WHEN event_id * 37 % 101 > 60 THEN 'HIGH' WHEN event_id * 37 % 101 > 30 THEN 'SUSPICIOUS' WHEN event_id % 97 = 0 THEN NULL ELSE 'CLEAN' END AS risk_level,
       CASE event_id % 6 WHEN 0 THEN 'blank_author' WHEN 1 THEN 'http_only|suspicious_tld' WHEN 2 THEN 'metadata_mismatch|blank_author' WHEN 3 THEN 'http_only|bank_name_typosquat|many_hyphens' WHEN 4 THEN 'rule_' || (user_id % 40) ELSE '' END AS indicator_list,
       CASE event_id % 4 WHEN 0 THEN 'salary|account' WHEN 1 THEN 'login|verify' WHEN 2 THEN 'kyc|word' || (user_id % 15) ELSE '' END AS keyword_list,
       ts AS created_at, user_id
FROM {events}
""")

# Threat-feed alerts and analyst cases.
define_input("alerts", """
SELECT o_orderkey AS id, o_orderdate AS ts,
       CASE o_orderkey % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'ip' WHEN 2 THEN 'upi_handle' ELSE 'hash' END AS indicator_type,
       CASE o_orderkey % 4 WHEN 0 THEN 'bad' || o_custkey || '.example.tk' WHEN 1 THEN '10.1.' || (o_custkey % 200) || '.9' WHEN 2 THEN 'scam' || o_custkey || '@ybl' ELSE md5(CAST(o_orderkey AS STRING)) END AS value,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'Reported by feed ' || (o_custkey % 12) || ' campaign' END AS description
FROM {orders}
""")
define_input("cases", """
SELECT c_custkey AS id, 'Case of ' || c_name AS title,
       'Segment ' || c_mktsegment || ' loss' AS description,
       CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'review' END AS status,
       CASE c_custkey % 4 WHEN 0 THEN 'high' ELSE 'medium' END AS severity,
       CASE WHEN c_custkey % 8 = 0 THEN 'Linked to campaign ' || c_nationkey ELSE NULL END AS notes
FROM {customer}
""")

# Predictions of two models with truth, slices, latency; one row per order line.
define_input("predictions", """
SELECT record_id,
       CASE WHEN truth = 1 THEN CASE WHEN u1 % 3 = 0 THEN 'SUSPICIOUS' ELSE 'HIGH' END ELSE 'CLEAN' END AS true_label,
       truth, score_a, score_b,
       CASE WHEN score_a < 30 THEN 'CLEAN' WHEN score_a < 60 THEN 'SUSPICIOUS' ELSE 'HIGH' END AS label_a,
       CASE WHEN score_b < 30 THEN 'CLEAN' WHEN score_b < 60 THEN 'SUSPICIOUS' ELSE 'HIGH' END AS label_b,
       latency_ms, module, app, difficulty,
       CASE WHEN u1 % 53 = 0 THEN 'timeout' ELSE NULL END AS error,
       CASE WHEN u1 % 11 = 0 THEN 'No active signals provided' ELSE 'scored' END AS explanation,
       CASE WHEN u1 % 7 = 0 THEN 1 ELSE 0 END AS flag_count
FROM (
  SELECT *, CAST(floor(u1 * (CASE WHEN truth = 1 THEN 99e-2 ELSE 55e-2 END)) AS INT) AS score_a,
         CAST(floor(u2 * (CASE WHEN truth = 1 THEN 9e-1 ELSE 7e-1 END)) AS INT) AS score_b
  FROM (
    SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(floor(l_extendedprice) AS BIGINT) AS record_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS truth,
           (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 101 AS u1,
           (l_orderkey * 6271 + l_linenumber * 50021 + l_suppkey * 17) % 101 AS u2,
           (l_partkey * 13 % 997) / 10e0 + l_linenumber AS latency_ms,
           CASE l_suppkey % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'upi' ELSE 'document' END AS module,
           CASE l_partkey % 4 WHEN 0 THEN 'phonepay' WHEN 1 THEN 'googlepay' WHEN 2 THEN 'paytm' ELSE 'bhim' END AS app,
           CASE WHEN l_quantity < 17 THEN 'easy' WHEN l_quantity < 34 THEN 'medium' ELSE 'hard' END AS difficulty
    FROM {lineitem}
  ) base
) scored
""")

# Provider verdicts per record; some records have none, some are unknown.
define_input("consensus", """
SELECT record_id, provider,
       CASE WHEN k % 10 = 0 THEN 'unknown' WHEN k % 3 = 0 THEN 'benign' WHEN k % 3 = 1 THEN 'phishing' ELSE 'suspicious' END AS raw_label,
       (k % 50) / 50e0 AS confidence
FROM (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(floor(l_extendedprice) AS BIGINT) AS record_id, 'vendor_a' AS provider, l_partkey + l_linenumber AS k FROM {lineitem} WHERE l_partkey % 8 <> 0
  UNION ALL
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(floor(l_extendedprice) AS BIGINT), 'vendor_b', l_suppkey * 3 + l_partkey FROM {lineitem} WHERE l_suppkey % 5 <> 0
  UNION ALL
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(floor(l_extendedprice) AS BIGINT), 'vendor_c', l_orderkey + l_suppkey FROM {lineitem} WHERE l_orderkey % 3 <> 0
) votes
""")

# Dataset records (manifest rows) of three kinds, with raw labels and metadata text.
define_input("records", """
SELECT seq, id, dataset_type, path_or_value, raw_label, split, source, meta_note, meta_owner, has_fusion_key
FROM (
  SELECT page_id * 3 AS seq, 'rec_' || (CASE WHEN page_id % 40 = 39 THEN page_id - 1 ELSE page_id END) AS id, 'URL' AS dataset_type,
         CASE WHEN page_id % 13 = 0 THEN 'https://dup.example.com/' || (page_id % 26) ELSE url END AS path_or_value,
         CASE page_id % 7 WHEN 0 THEN 'Benign' WHEN 1 THEN 'fraud' WHEN 2 THEN 'WARN' WHEN 3 THEN '0' WHEN 4 THEN ' high ' WHEN 5 THEN 'n/a' ELSE 'clean' END AS raw_label,
         'BENCHMARK' AS split, 'crawl' AS source,
         CASE page_id % 6 WHEN 0 THEN 'mail me at jo.e' || page_id || '@corp.example.com' WHEN 1 THEN 'call 987-654-' || lpad(CAST(page_id % 10000 AS STRING), 4, '0') WHEN 2 THEN 'paid via shop' || page_id || '@okaxis' ELSE 'nothing' END AS meta_note,
         CASE page_id % 4 WHEN 0 THEN '/home/user' || page_id || '/data' WHEN 1 THEN '/Users/Public/x' ELSE 'lab' END AS meta_owner,
         page_id % 10 = 0 AS has_fusion_key
  FROM {pages}
  UNION ALL
  SELECT doc_id * 3 + 1, 'doc_' || doc_id, 'DOCUMENT', '/data/files/' || source || '/' || doc_id || '.pdf',
         CASE doc_id % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'malicious' ELSE 'medium' END, CASE doc_id % 5 WHEN 0 THEN 'TEST' ELSE 'TRAIN' END,
         source, lang, 'lab', false
  FROM {documents}
  UNION ALL
  SELECT o_orderkey * 3 + 2, 'upi_' || o_orderkey, 'UPI_SCREENSHOT',
         'UTR ' || lpad(CAST(o_orderkey AS STRING), 12, '4') || ' to user' || o_custkey || '@ybl Rs. ' || (o_orderkey % 900) || ' see https://pay.example.com/r?id=' || o_orderkey,
         CASE o_orderkey % 2 WHEN 0 THEN 'OK' ELSE 'BAD' END, 'VALIDATION', 'upi', 'clerk ' || (o_custkey % 9), 'lab', o_orderkey % 20 = 0
  FROM {orders}
) every
""")

# Ordered prediction errors per module, with a shift half way through each module's stream.
define_input("error_stream", """
SELECT 'module_' || (user_id % 4) AS module, ts, event_id,
       CASE WHEN (event_id * 7919 + user_id * 104729) % 1000 < (CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 50 ELSE 400 END) THEN 1 ELSE 0 END AS error
FROM {events}
""")

# Receipt training rows: six features and a label, with split and slices.
define_input("receipt_features", """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(floor(l_extendedprice) AS BIGINT) AS id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       CASE l_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split,
       CASE l_partkey % 4 WHEN 0 THEN 'phonepay' WHEN 1 THEN 'googlepay' WHEN 2 THEN 'paytm' ELSE 'bhim' END AS app,
       CASE WHEN l_returnflag = 'R' THEN CASE l_suppkey % 3 WHEN 0 THEN 'overlay' WHEN 1 THEN 'font' ELSE 'color' END ELSE NULL END AS forgery_type,
       CASE WHEN l_quantity < 17 THEN 'easy' WHEN l_quantity < 34 THEN 'medium' ELSE 'hard' END AS difficulty,
       (l_partkey * 7 % 100) / 100e0 + (CASE WHEN l_returnflag = 'R' THEN 3e-1 ELSE 0e0 END) AS brand_palette_distance,
       (l_suppkey * 11 % 60) / 100e0 + (CASE WHEN l_returnflag = 'R' THEN 2e-1 ELSE 0e0 END) AS text_height_variance,
       (l_orderkey * 3 % 80) / 100e0 + (CASE WHEN l_returnflag = 'R' THEN 1e-1 ELSE 0e0 END) AS ela_hotspot_density,
       CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 0e0 ELSE 1e0 END AS utr_valid,
       (l_orderkey * 37 % 100) / 100e0 AS ocr_confidence,
       CASE WHEN l_suppkey % 4 = 0 THEN 0e0 ELSE 1e0 END AS font_consistent
FROM {lineitem}
""")

"""DuckDB statements for the queries that SQL can express."""

MIXING = """
WITH RECURSIVE base AS (
  SELECT doc_id, source AS given, CASE WHEN source IS NULL THEN 'null' ELSE 's:' || source END AS source,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
), shares AS (
  SELECT source, CAST(floor(sqrt(count(*)) * 1000) AS BIGINT) AS share FROM base GROUP BY source
), parts AS (
  SELECT source, (1000 - (SELECT count(*) FROM shares)) * share // (SELECT CAST(sum(share) AS BIGINT) FROM shares) AS whole,
         (1000 - (SELECT count(*) FROM shares)) * share % (SELECT CAST(sum(share) AS BIGINT) FROM shares) AS part
  FROM shares
), quotas AS (
  SELECT source, whole + 1 + CASE WHEN row_number() OVER (ORDER BY part DESC, source)
         <= 1000 - (SELECT count(*) FROM shares) - (SELECT sum(whole) FROM parts) THEN 1 ELSE 0 END AS quota
  FROM parts
), lists AS (
  SELECT list(CAST(quota AS BIGINT) ORDER BY source) AS q, list(source ORDER BY source) AS names FROM quotas
), walk AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(q, lambda x: CAST(0 AS BIGINT)) AS done, q, CAST(NULL AS BIGINT) AS pick FROM lists
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = next THEN 1 ELSE 0 END), q, next
  FROM (
    SELECT *, list_min(list_filter(list_transform(range(1, len(q) + 1), lambda i:
      CASE WHEN done[i] < q[i] AND done[i] * 1000 // q[i] <= t THEN (((done[i] + 1) * 1000 + q[i] - 1) // q[i]) * 1000 + i END),
      lambda x: x IS NOT NULL)) % 1000 AS next
    FROM walk WHERE t < 1000
  )
), slots AS (
  SELECT names[pick] AS source, q[pick] AS quota, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn
  FROM (SELECT t, pick, q FROM walk WHERE t > 0), (SELECT names FROM lists)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY digest, doc_id) - 1 AS k FROM base
)
SELECT doc_id, given AS source, k // 16 AS block, (k // 16) * 1000 // quota AS release,
       ((k // 16 + 1) * 1000 + quota - 1) // quota AS deadline, (k // 16 // quota) * 1000 + slot AS slot, k % 16 AS place
FROM numbered n JOIN slots s ON s.source = n.source AND s.turn = (k // 16) % quota
"""

SUBSTRING = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), firsts AS (
  SELECT h, min(doc_id) AS least FROM windows GROUP BY h
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (h) WHERE least < doc_id)
  GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
         CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_select(w, list_sort(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)))), ' ') END AS kept
  FROM words LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM kept
"""


def merkle(heights: tuple[int, int] = (8, 4)) -> str:
    """Levels written out: at most 8 ** 8 leaves a scope and 8 ** 4 scopes."""
    framed = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    rest = " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = framed("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    # crc32 of the id's decimal digits, bit by bit
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: {step}), 4294967295)"
    parts = [
        f"leaves AS (SELECT doc_id, lang, sha256({rest} || {framed('text')}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({rest} || {lowered}) END AS tampered FROM documents)",
        "a0 AS (SELECT doc_id, lang, leaf AS digest, coalesce(tampered, leaf) AS h, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves)",
    ]

    def levels(name: str, high: int) -> None:
        for k in range(high):
            parts.append(f"{name}{k}r AS (SELECT lang, idx // 8 AS run, list(digest ORDER BY idx) AS ds, any_value((n + 7) // 8) AS m FROM {name}{k} WHERE n > 1 GROUP BY lang, idx // 8)")
            parts.append(f"{name}{k + 1} AS (SELECT lang, run AS idx, sha256(array_to_string(ds, '')) AS digest, m AS n FROM {name}{k}r)")

    def climb(prefix: str, name: str, high: int, at: str, by: str) -> str:
        for k in range(high):
            p = f"({at} // {8**k} % 8)"
            left, right = f"coalesce(array_to_string(r.ds[1:{p}], ''), '')", f"coalesce(array_to_string(r.ds[{p} + 2:], ''), '')"
            parts.append(f"{prefix}{k + 1} AS (SELECT w.* REPLACE (CASE WHEN r.ds IS NULL THEN h ELSE sha256({left} || h || {right}) END AS h, CASE WHEN r.ds IS NULL THEN proof ELSE proof || {left} || {right} END AS proof) FROM {prefix}{k} w LEFT JOIN {name}{k}r r ON {by} AND r.run = w.{at} // {8 ** (k + 1)})")
        return f"{prefix}{high}"

    low, high = heights
    levels("a", low)
    tops = " UNION ALL ".join(f"SELECT lang, digest FROM a{k} WHERE n = 1" for k in range(low + 1))
    parts.append(f"subs AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM ({tops}))")
    parts.append("b0 AS (SELECT 'top' AS lang, place AS idx, subroot AS digest, count(*) OVER () AS n FROM subs)")
    levels("b", high)
    parts.append("root AS (" + " UNION ALL ".join(f"SELECT digest AS root FROM b{k} WHERE n = 1" for k in range(high + 1)) + ")")
    parts.append("w0 AS (SELECT a.doc_id, a.lang, a.idx, a.digest AS leaf, a.h, '' AS proof, s.subroot, s.place FROM a0 a JOIN subs s ON s.lang IS NOT DISTINCT FROM a.lang)")
    last = climb("w", "a", low, "idx", "r.lang IS NOT DISTINCT FROM w.lang")
    parts.append(f"v0 AS (SELECT * FROM {last})")
    last = climb("v", "b", high, "place", "r.lang = 'top'")
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM {last}, root"

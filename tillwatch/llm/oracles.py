"""DuckDB SQL that the queries must equal, where SQL can express the operator."""

from __future__ import annotations

from . import licenses
from .decontamination import WINDOW
from .lexical import LENGTH_SHARE, TERM
from .licenses import DRIFT, ENOUGH, GAP, K
from .merkle import FANOUT
from .mixing import UNIT
from .sharding import BYTE, PARTS, SHARDS, SLOTS

A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def mixing_sql(table: str = "documents", select: str = "") -> str:
    select = select or "doc_id, size, source_size, target, copies * size AS taken, source, copies"
    return rf"""
WITH sized AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '{NOT_SPACE}')), 0)::BIGINT AS size,
         coalesce('s' || source, 'n') AS src,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 8))::UBIGINT AS hash
  FROM {table}
), placed AS (
  SELECT *, (size >> greatest(length(bin(size)) - 5, 0)) + 32 * greatest(length(bin(size)) - 5, 0) AS class FROM sized
), sources AS (
  SELECT src, min(source) AS source, sum(size)::BIGINT AS source_size FROM placed GROUP BY src
), ranked AS (
  SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS w,
         3.0::DOUBLE * source_size AS lim FROM sources
), levels AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE
            - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weights
  FROM ranked WINDOW o AS (ORDER BY lim / w, source NULLS LAST)
), filled AS (
  SELECT *, lim <= rest / weights * w AS is_full FROM levels
), plan AS (
  SELECT src, source_size,
         CASE WHEN is_full THEN lim ELSE max(CASE WHEN NOT is_full THEN rest / weights END) OVER () * w END AS target
  FROM filled
), units AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * {UNIT}.0::DOUBLE)::HUGEINT ELSE 0 END AS unit,
         floor(('0x' || substr(md5('11:' || src), 1, 8))::UBIGINT::DOUBLE / 4294967296 * {UNIT}.0::DOUBLE)::HUGEINT AS start
  FROM plan
), summed AS (
  SELECT p.*, u.source_size, u.target, u.unit,
         u.start + u.unit * row_number() OVER (PARTITION BY src ORDER BY class, hash, size, doc_id NULLS FIRST)::HUGEINT AS last
  FROM placed p JOIN units u USING (src)
), taken AS (
  SELECT *, (last // {UNIT} - (last - unit) // {UNIT})::BIGINT AS copies FROM summed
)
SELECT {select} FROM taken"""


def licenses_sql() -> str:
    rows = [(n, label, text, n < len(licenses.PHRASES)) for n, (text, label) in enumerate(
        [*licenses.PHRASES.items(), *((text, label) for label, text in licenses.TEMPLATES)]
    )]
    values = ", ".join(f"({n}, '{label}', '{text}', {str(phrase).upper()})" for n, label, text, phrase in rows)
    return rf"""
WITH templates AS (
  SELECT template, label, phrase, string_split(text, ' ') AS w FROM (VALUES {values}) AS t (template, label, text, phrase)
), grams AS (
  SELECT template, label, phrase, len(w) - {K - 1} AS size, unnest(range(len(w) - {K - 1})) AS place, w FROM templates
), triples AS (
  SELECT template, label, phrase, size, place, array_to_string(w[place + 1:place + {K}], ' ') AS gram FROM grams
), apart AS (
  SELECT a.template, a.size, o.template AS other, a.place
  FROM triples a JOIN (SELECT DISTINCT template, label FROM triples WHERE NOT phrase) o ON a.label <> o.label
  WHERE NOT a.phrase AND NOT EXISTS (SELECT 1 FROM triples b WHERE b.template = o.template AND b.gram = a.gram)
), tells AS (
  SELECT template, other, list(place) AS telling FROM apart GROUP BY template, other, size HAVING count(*) <= size * (1 - {ENOUGH})
), docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '{LETTERS}') AS w FROM documents
), rolled AS (
  SELECT r, place AS pos, array_to_string(w[place + 1:place + {K}], ' ') AS gram
  FROM (SELECT r, w, unnest(range(len(w) - {K - 1})) AS place FROM docs WHERE len(w) >= {K})
), diagonals AS (
  SELECT r, template, label, phrase, size, pos - place AS diagonal, count(*) AS votes, min(pos) AS low, max(pos) AS high,
         list(DISTINCT place) AS places
  FROM rolled JOIN triples USING (gram) GROUP BY ALL
), inside AS (
  SELECT *, max([high, votes, diagonal]) OVER (
    PARTITION BY r, template ORDER BY low, high DESC, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS outermost
  FROM diagonals
), straight AS (
  SELECT * EXCLUDE (outermost) FROM inside
  WHERE phrase OR outermost IS NULL OR outermost[1] < high OR outermost[2] <= votes OR abs(diagonal - outermost[3]) <= {DRIFT}
), starts AS (
  SELECT *, CASE WHEN phrase OR lag(high) OVER o IS NULL OR low - lag(high) OVER o > {GAP}
                   OR abs(diagonal - lag(diagonal) OVER o) > {DRIFT} THEN 1 ELSE 0 END AS fresh
  FROM straight WINDOW o AS (PARTITION BY r, template ORDER BY low, diagonal)
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY low, diagonal) AS span FROM starts
), spans AS (
  SELECT r, template, label, phrase, size, span, least(sum(votes) / size, 1.0)::DOUBLE AS share, min(low) AS low,
         flatten(list(places)) AS places
  FROM numbered GROUP BY r, template, label, phrase, size, span
), kept AS (
  SELECT * FROM spans s WHERE share >= CASE WHEN phrase THEN 1.0 ELSE {ENOUGH} END
    AND NOT EXISTS (SELECT 1 FROM tells t WHERE t.template = s.template AND NOT list_has_any(t.telling, s.places))
), found AS (
  SELECT r, count(*) FILTER (phrase) AS n_base, min(low) FILTER (phrase) AS first_word, max(low) FILTER (phrase) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM kept GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN found USING (r)"""


def decontamination_sql(table: str = "documents", select: str = "") -> str:
    select = select or """doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated"""
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, *,
         regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '{LETTERS}') AS w FROM {table}
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '{LETTERS}') AS w FROM benchmark
), sized AS (
  SELECT *, least(len(w), {WINDOW}) AS size FROM items WHERE len(w) > 0
), starts AS (
  SELECT *, unnest(range(len(w) - size + 1)) AS p FROM sized
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p + 1:p + size], ' ') AS gram FROM starts
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT r, size, w, unnest(range(len(w) - size + 1)) AS p FROM docs CROSS JOIN sizes WHERE len(w) >= size
), grams AS (
  SELECT r, size, p, array_to_string(w[p + 1:p + size], ' ') AS gram FROM places
), occurrences AS (
  SELECT r, p, size, item_id FROM grams JOIN windows USING (size, gram)
), hit AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS place FROM occurrences) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM occurrences GROUP BY r
)
SELECT {select} FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""


EMBEDDINGS_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e)
  WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), walk AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT links.b, walk.root FROM walk JOIN links ON links.a = walk.node
), roots AS (
  SELECT node, min(root) AS component_id FROM walk GROUP BY node
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN roots ON node = vec_id LEFT JOIN counts ON a = vec_id"""


#: The table of CRC-32, one row: t[b + 1] is the remainder of byte b.
CRC_TABLE = """crc_steps AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc_steps WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8
)"""


def crc32_sql(text: str) -> str:
    """CRC-32 of ``text`` in UTF-8, unsigned; needs crc_table."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    step = "lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), {step}), 4294967295)::BIGINT"


LEXICAL_SQL = rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{TERM}'),
         lambda t: translate(t, {A_TO_Z})) AS w FROM documents
), sizes AS (
  SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM words WHERE len(w) > 0
), postings AS (
  SELECT r, term, count(*)::BIGINT AS tf, any_value(n) AS n FROM (SELECT r, unnest(w) AS term, len(w)::BIGINT AS n FROM words) GROUP BY 1, 2
), frequencies AS (
  SELECT term, count(*) AS df FROM postings GROUP BY term
), items AS (
  SELECT DISTINCT q, item_id, translate(term, {A_TO_Z}) AS term FROM (
    SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(coalesce(text, ''), '{TERM}')) AS term FROM benchmark)
), weighted AS (
  SELECT q, item_id, term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM items JOIN frequencies USING (term), sizes
), scored AS (
  SELECT q, item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - {LENGTH_SHARE} + ({LENGTH_SHARE} * n * docs) // terms))))::BIGINT AS score
  FROM weighted JOIN postings USING (term), sizes GROUP BY 1, 2, 3
), ranked AS (
  SELECT q, item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
  FROM scored JOIN words USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""

#: Levels that the manifest's SQL spells out: enough for 16 ** 7 leaves of a source.
MERKLE_LEVELS = 7


def _merkle_levels(name: str, nodes: str, part: str, member: str) -> str:
    """``{name}_0`` (part, pos, h) up to ``{name}_{MERKLE_LEVELS}``, the runs between them, and ``{name}_fold``:
    ``member`` (part, pos, h, alt) with its root, the altered one and its siblings, level by level."""
    steps = [f"{name}_0 AS (SELECT {part} AS part, pos, h FROM {nodes})"]
    folds, now = [], f"(SELECT part, pos, h, alt, '' AS proof FROM {member})"
    for n in range(MERKLE_LEVELS):
        steps.append(f"""{name}_runs_{n} AS (
  SELECT part, run, text, count(*) OVER (PARTITION BY part) > 1 OR members > 1 AS several FROM (
    SELECT part, pos // {FANOUT} AS run, string_agg(h, '' ORDER BY pos) AS text, count(*) AS members FROM {name}_{n} GROUP BY 1, 2)
), {name}_{n + 1} AS (
  SELECT part, run AS pos, CASE WHEN several THEN sha256(text) ELSE text END AS h FROM {name}_runs_{n}
)""")
        at = f"m.pos // {FANOUT**n} % {FANOUT}"
        left, right = f"substr(text, 1, 64 * ({at})::INT)", f"substr(text, 64 * ({at})::INT + 65)"
        folds.append(f"""{name}_fold_{n} AS (
  SELECT m.part, m.pos, CASE WHEN several THEN sha256({left} || m.alt || {right}) ELSE m.alt END AS alt, m.h,
         m.proof || {left} || {right} AS proof
  FROM {now} m JOIN {name}_runs_{n} r ON r.part = m.part AND r.run = m.pos // {FANOUT**(n + 1)}
)""")
        now = f"{name}_fold_{n}"
    return ", ".join([*steps, *folds])


def merkle_sql() -> str:
    def leaf(text: str) -> str:
        fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"

    last = MERKLE_LEVELS
    return f"""
WITH RECURSIVE {CRC_TABLE}, leaves AS (
  SELECT doc_id, source, coalesce('1' || source, '0') AS part, {leaf('text')} AS h,
         CASE WHEN {crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 5 = 0 AND doc_id IS NOT NULL
              THEN {leaf(f"translate(text, {A_TO_Z})")} ELSE {leaf('text')} END AS alt
  FROM documents, crc_table
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves
), {_merkle_levels("leaf", "placed", "part", "placed")}, subroots AS (
  SELECT part, h AS subroot, row_number() OVER (ORDER BY part) - 1 AS place FROM leaf_{last}
), sources AS (
  SELECT '' AS part, place AS pos, subroot AS h FROM subroots
), proved AS (
  SELECT f.part, f.pos, '' AS top, s.place, f.alt, f.proof FROM leaf_fold_{last - 1} f JOIN subroots s USING (part)
), {_merkle_levels("top", "sources", "part", "(SELECT '' AS part, place AS pos, part || ':' || pos AS h, alt FROM proved)")}
SELECT p.doc_id, p.h AS leaf, s.subroot, r.h AS root, sha256(v.proof || t.proof) AS proof_sha256, t.alt AS folded_root,
       t.alt = r.h AS verified, p.source, p.pos
FROM placed p JOIN subroots s USING (part) JOIN proved v ON v.part = p.part AND v.pos = p.pos
JOIN top_fold_{last - 1} t ON t.h = p.part || ':' || p.pos CROSS JOIN top_{last} r"""


def _least(load: str, first: int) -> str:
    """Number of the least loaded shard from ``first`` on."""
    return f"list_position({load}[{first + 1}:], list_min({load}[{first + 1}:]))::INT - 1 + {first}"


def _dealt_sql(name: str, slots: str, shards: int, first: int) -> str:
    place = f"coalesce(q.shard, {_least('d.load', first)})"
    return f"""{name}_order AS (
  SELECT slot, shard, bytes * {BYTE} + 1 AS weight,
         row_number() OVER (ORDER BY (shard IS NULL), bytes DESC, slot) AS n FROM {slots}
), {name}_steps AS (
  SELECT 0::BIGINT AS n, -1 AS slot, -1 AS shard, list_transform(range({shards}), lambda x: 0::BIGINT) AS load
  UNION ALL
  SELECT q.n, q.slot, {place},
         list_transform(d.load, lambda v, i: CASE WHEN i - 1 = {place} THEN v + q.weight ELSE v END)
  FROM {name}_steps d JOIN {name}_order q ON q.n = d.n + 1
), {name} AS (
  SELECT slot, shard FROM {name}_steps WHERE n > 0
)"""


def sharding_sql() -> str:
    return f"""
WITH RECURSIVE {CRC_TABLE}, records AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 1 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k, row_number() OVER () AS r
  FROM documents, crc_table
), slotted AS (
  SELECT *, (('0x' || substr(k, 1, 8))::BIGINT % {SLOTS})::INT AS virtual_slot,
         (('0x' || substr(k, 9, 4))::BIGINT % {PARTS})::INT AS part FROM records
), sums AS (
  SELECT virtual_slot AS slot, sum(size)::BIGINT AS bytes FROM slotted GROUP BY 1
), sizes AS (
  SELECT i::INT AS slot, coalesce(bytes, 0) AS bytes FROM range({SLOTS}) AS r(i) LEFT JOIN sums ON slot = i
), unplaced AS (
  SELECT slot, bytes, CASE WHEN bytes = 0 THEN slot % {SHARDS} END AS shard FROM sizes
), {_dealt_sql("present", "unplaced", SHARDS, 0)}, held AS (
  SELECT slot, bytes, shard, sum(bytes * {BYTE} + 1) OVER (PARTITION BY shard ORDER BY bytes DESC, slot
           ROWS UNBOUNDED PRECEDING) AS held, sum(bytes * {BYTE} + 1) OVER () AS whole
  FROM present JOIN sizes USING (slot)
), edited AS (
  SELECT slot, bytes, CASE WHEN bytes = 0 AND slot % {SHARDS + 1} >= {SHARDS} THEN slot % {SHARDS + 1}
                           WHEN bytes = 0 OR held * {SHARDS + 1} <= whole THEN shard END AS shard FROM held
), {_dealt_sql("later", "edited", SHARDS + 1, SHARDS)}
SELECT s.doc_id, s.size, s.text_crc32, 'bytes' AS law, p.shard,
       row_number() OVER (PARTITION BY p.shard ORDER BY s.virtual_slot, s.part, s.k, s.r)::BIGINT - 1 AS slot,
       NULL::INT AS grown_shard, s.virtual_slot, l.shard AS next_shard
FROM slotted s JOIN present p ON p.slot = s.virtual_slot JOIN later l ON l.slot = s.virtual_slot"""


ORACLES = {
    "op3_mixing": mixing_sql(),
    "op4_license_scans": licenses_sql(),
    "op7_decontamination": decontamination_sql(),
    "op9_embedding_dedup": EMBEDDINGS_SQL,
    "op11_merkle_manifest": merkle_sql(),
    "op12_lexical_search": LEXICAL_SQL,
    "op13_sharding": sharding_sql(),
}

"""The same answers in plain SQL, written independently of the Spark plans.

A second engine runs these on the same tables.  Queries whose core is alignment or
clustering have no SQL twin; they are tested against brute force.
"""

from __future__ import annotations

from cladeflow.functions.labels import INTRINSIC_MARKERS
from cladeflow.functions.sequence import CODON_AMINO_ACIDS
from cladeflow.params import PERMUTATIONS, SEED
from cladeflow.views import BASES, GENE_HIT, LETTERS, REPLICON_HIT

ORACLE: dict[str, str] = {}
SOURCES = sorted(f"src{i}" for i in range(20))
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _kmers(name: str, table: str, key: str, k: int) -> str:
    return (f"{name} AS (SELECT DISTINCT {key} AS id, unnest(list_transform(range(1, length(text) - {k} + 2), "
            f"lambda i: substr(text, i, {k}))) AS kmer FROM {table})")


def _containment(table: str, key: str, k: int, gate: float) -> str:
    return f"""
WITH {_kmers('q', table, key, k)}, {_kmers('r', 'benchmark', 'item_id', k)},
n AS (SELECT id, count(*) AS n_ref FROM r GROUP BY id),
m AS (SELECT q.id AS query_id, r.id AS ref_id, count(*) AS shared FROM q JOIN r USING (kmer) GROUP BY ALL)
SELECT query_id, ref_id, shared, n_ref, round(shared / n_ref, 6) AS containment
FROM m JOIN n ON n.id = ref_id WHERE shared / n_ref >= {gate}"""


ORACLE["benchmark_containment"] = _containment("documents", "doc_id", 12, 0.30)
ORACLE["kmer_prefilter"] = _containment("documents", "doc_id", 10, 0.20)
ORACLE["topk_candidates"] = f"""
WITH {_kmers('q', 'documents', 'doc_id', 12)}, {_kmers('r', 'benchmark', 'item_id', 12)},
m AS (SELECT q.id AS query_id, r.id AS ref_id, count(*) AS shared FROM q JOIN r USING (kmer) GROUP BY ALL)
SELECT query_id, ref_id, shared, CAST(row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, ref_id) AS INTEGER) AS rank
FROM m QUALIFY rank <= 25"""
ORACLE["best_hit"] = """
SELECT 's' || l_suppkey AS strain, p_brand AS replicon, l_orderkey * 8 + l_linenumber AS ref_id,
       round(l_quantity / 50, 6) AS identity, round(1 - l_discount, 6) AS coverage
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_quantity / 50 >= 0.90 AND 1 - l_discount >= 0.60
QUALIFY row_number() OVER (PARTITION BY l_suppkey, p_brand ORDER BY l_quantity DESC, l_discount, l_orderkey * 8 + l_linenumber) = 1"""

# ---- genomes -------------------------------------------------------------------------------


def _contigs(strain: str = "source || '|' || lang") -> str:
    return (f"contigs AS (SELECT {strain} AS strain, CAST(doc_id AS VARCHAR) AS contig, "
            f"translate(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), '{LETTERS}', '{BASES}') AS seq FROM documents)")


_CODON = "c[{0}]"
_INDEX = " + ".join(f"{w} * (strpos('TCAG', {_CODON.format(o)}) - 1)" for o, w in ((1, 16), (2, 4), (3, 1)))
_KNOWN = " AND ".join(f"strpos('TCAG', {_CODON.format(o)}) > 0" for o in (1, 2, 3))
_ORFS = f"""
strands AS (
  SELECT strain, contig, length(seq) AS size, '+' AS strand, seq AS t FROM contigs UNION ALL
  SELECT strain, contig, length(seq), '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM contigs),
frames AS (SELECT *, unnest([0, 1, 2]) AS f FROM strands),
aa AS (SELECT strain, contig, size, strand, t, f, array_to_string(list_transform(regexp_extract_all(substr(t, f + 1), '.{{3}}'),
  lambda c: CASE WHEN {_KNOWN} THEN substr('{CODON_AMINO_ACIDS}', {_INDEX} + 1, 1) ELSE 'X' END), '') AS p FROM frames),
parts AS (SELECT strain, contig, size, strand, t, f, string_split(p, '*') AS parts FROM aa),
pieces AS (SELECT strain, contig, size, strand, t, f, len(parts) AS n, unnest(parts) AS part,
  unnest(range(1, len(parts) + 1)) AS nth FROM parts),
placed AS (SELECT *, sum(length(part) + 1) OVER (PARTITION BY strain, contig, strand, f ORDER BY nth) AS stop FROM pieces),
found AS (SELECT *, substr(part, strpos(part, 'M')) AS protein, f + 3 * stop AS last FROM placed
  WHERE nth < n AND strpos(part, 'M') > 0),
genes AS (SELECT strain, contig, strand, size, t, protein, last, last - 3 * (length(protein) + 1) + 1 AS first
  FROM found WHERE length(protein) >= 30)"""
_STATS = """
size AS (SELECT strain, sum(length(seq)) AS n, sum(length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) AS gc
  FROM contigs GROUP BY strain),
called AS (SELECT strain, count(*) AS n_genes, sum(last - first + 1) AS nt, sum(length(protein)) AS aa FROM genes GROUP BY strain),
stats AS (SELECT strain, CAST(n AS BIGINT) AS genome_size, round(100 * gc / n, 2) AS gc_percent, coalesce(n_genes, 0) AS n_genes,
  round(coalesce(nt, 0) / n, 3) AS coding_density, coalesce(round(aa / n_genes, 1), 0) AS mean_gene_aa
  FROM size LEFT JOIN called USING (strain))"""
ORACLE["orf_calls"] = f"""
WITH {_contigs()}, {_ORFS}
SELECT strain, contig, CAST(CASE WHEN strand = '+' THEN first ELSE size - last + 1 END AS BIGINT) AS begin,
  CAST(CASE WHEN strand = '+' THEN last ELSE size - first + 1 END AS BIGINT) AS end_pos, strand,
  CAST(last - first + 1 AS BIGINT) AS length_nt, CAST(length(protein) AS BIGINT) AS length_aa,
  md5(protein) AS protein, md5(substr(t, CAST(first AS BIGINT), CAST(last - first + 1 AS BIGINT))) AS cds FROM genes"""
ORACLE["genome_stats"] = f"WITH {_contigs('source')}, {_ORFS}, {_STATS} SELECT * FROM stats"
ORACLE["cohort_stats"] = f"""WITH {_contigs('source')}, {_ORFS}, {_STATS}
SELECT count(*) AS n_genomes, round(avg(n_genes), 6) AS mean_genes, round(avg(coding_density), 6) AS mean_coding_density,
  CAST(sum(n_genes) AS BIGINT) AS total_genes FROM stats"""
ORACLE["gene_summary"] = f"""WITH {_contigs('source')}, {_ORFS}, {_STATS}
SELECT stats.strain, n_genes AS genes, round(genome_size / 1e6, 3) AS genome_mb, round(100 * coding_density, 1) AS coding_density_pct,
  CAST(round(avg(last - first + 1), 0) AS BIGINT) AS mean_gene_bp FROM stats LEFT JOIN genes ON genes.strain = stats.strain
GROUP BY stats.strain, n_genes, genome_size, coding_density"""
ORACLE["gene_fasta"] = """
WITH w AS (SELECT source || '|c' || doc_id AS header, array_to_string(regexp_extract_all(text, '(?s).{1,60}'), chr(10)) AS t FROM documents)
SELECT header, CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines, md5(t) AS body FROM w"""

# ---- distances -----------------------------------------------------------------------------


def _sketch(strain: str = "source || '|' || lang") -> str:
    return f"""{_contigs(strain)},
km AS (SELECT strain, unnest(list_transform(range(1, length(seq) - 29), lambda i: substr(seq, i, 31))) AS m FROM contigs),
canon AS (SELECT strain, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS m FROM km WHERE strpos(m, 'N') = 0),
hashed AS (SELECT DISTINCT strain, CAST('0x' || substr(md5(m), 1, 15) AS BIGINT) AS hash FROM canon),
sketch AS (SELECT * FROM hashed WHERE hash <= {(1 << 60) // 100})"""


def _pairs(table: str, row: str, item: str) -> str:
    return f"""
sizes AS (SELECT {row} AS s, count(*) AS n FROM {table} GROUP BY 1),
common AS (SELECT x.{row} AS a, y.{row} AS b, count(*) AS shared FROM {table} x JOIN {table} y
  ON x.{item} = y.{item} AND x.{row} < y.{row} GROUP BY 1, 2),
pairs AS (SELECT a, b, shared, p.n AS n_a, q.n AS n_b, shared / (p.n + q.n - shared) AS jaccard
  FROM common JOIN sizes p ON p.s = a JOIN sizes q ON q.s = b)"""


_ANI = "ani AS (SELECT *, 100 * (1 + ln(2 * jaccard / (1 + jaccard)) / 31) AS ani FROM pairs)"
ORACLE["minhash_sketch"] = f"""WITH {_sketch()}
SELECT strain, count(*) AS n_hashes, min(hash) AS low, max(hash) AS high FROM sketch GROUP BY strain"""
ORACLE["whole_genome_sketch"] = f"""WITH {_contigs('source')},
joined AS (SELECT strain, string_agg(seq, '' ORDER BY CAST(contig AS BIGINT)) AS seq FROM contigs GROUP BY strain),
cut AS (SELECT strain, unnest(list_transform(range(0, length(seq) // 1000 + 1), lambda i: substr(seq, i * 1000 + 1, 1030))) AS seq FROM joined),
km AS (SELECT strain, unnest(list_transform(range(1, length(seq) - 29), lambda i: substr(seq, i, 31))) AS m FROM cut),
canon AS (SELECT strain, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS m FROM km WHERE strpos(m, 'N') = 0),
hashed AS (SELECT DISTINCT strain, CAST('0x' || substr(md5(m), 1, 15) AS BIGINT) AS hash FROM canon)
SELECT strain, count(*) AS n_hashes, min(hash) AS low, max(hash) AS high FROM hashed WHERE hash <= {(1 << 60) // 1000} GROUP BY strain"""
ORACLE["minhash_ani"] = f"""WITH {_sketch()}, {_pairs('sketch', 'strain', 'hash')}, {_ANI}
SELECT a, b, shared, n_a, n_b, round(jaccard, 6) AS jaccard, round(ani, 6) AS ani FROM ani"""
ORACLE["ani_by_host"] = f"""WITH {_sketch()}, {_pairs('sketch', 'strain', 'hash')}, {_ANI}
SELECT CASE WHEN string_split(a, '|')[2] = string_split(b, '|')[2] THEN 'same' ELSE 'different' END AS host,
  count(*) AS n_pairs, round(avg(ani), 6) AS mean, round(min(ani), 6) AS low, round(max(ani), 6) AS high FROM ani GROUP BY 1"""
ORACLE["ani_range"] = f"""WITH {_sketch()}, {_pairs('sketch', 'strain', 'hash')}, {_ANI}
SELECT count(*) AS n_pairs, round(min(ani), 6) AS low, round(max(ani), 6) AS high,
  CAST(count_if(ani >= 95) AS BIGINT) AS n_same_species FROM ani"""
ORACLE["ani_matrix"] = f"""WITH {_sketch('source')}, {_pairs('sketch', 'strain', 'hash')}, {_ANI},
both_ways AS (SELECT a, b, ani FROM ani UNION ALL SELECT b, a, ani FROM ani),
names AS (SELECT DISTINCT source AS a FROM documents)
SELECT a, b, round(ani, 4) AS ani FROM both_ways UNION ALL SELECT a, a, 100.0 FROM names"""
ORACLE["pairwise_jaccard"] = f"""
WITH {_kmers('d', 'documents', 'source', 12)}, {_pairs('d', 'id', 'kmer')}
SELECT a, b, shared, n_a, n_b, round(jaccard, 6) AS jaccard FROM pairs"""


def _alignment(taxon: str) -> str:
    return f"""
cells AS (SELECT {taxon} AS taxon, l_partkey AS part, month(l_shipdate) AS m, min(l_returnflag) AS residue
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""


ORACLE["site_patterns"] = f"""WITH {_alignment('r_name')},
p AS (SELECT part, m, string_agg(taxon || ':' || residue, ',' ORDER BY taxon) AS pattern FROM cells GROUP BY part, m)
SELECT pattern, count(*) AS n_sites FROM p GROUP BY pattern"""
ORACLE["supermatrix"] = f"""WITH {_alignment('r_name')},
whole AS (SELECT part FROM cells GROUP BY part HAVING count(DISTINCT taxon) = (SELECT count(*) FROM region)),
kept AS (SELECT cells.* FROM cells JOIN whole USING (part)),
width AS (SELECT part, max(m) AS w FROM kept GROUP BY part),
start AS (SELECT part, w, sum(w) OVER (ORDER BY part) - w AS s FROM width),
grid AS (SELECT r_name AS taxon, part, s, unnest(range(1, w + 1)) AS m FROM start, region),
filled AS (SELECT taxon, s + m - 1 AS site, coalesce(residue, '-') AS residue FROM grid LEFT JOIN kept USING (taxon, part, m))
SELECT taxon, CAST(site // 60 AS BIGINT) AS line, string_agg(residue, '' ORDER BY site) AS text FROM filled GROUP BY 1, 2"""
_DISTANCE = f"""{_alignment('n_name')},
p AS (SELECT x.taxon AS a, y.taxon AS b, count(*) AS compared, CAST(count_if(x.residue = y.residue) AS BIGINT) AS equal
  FROM cells x JOIN cells y ON x.part = y.part AND x.m = y.m AND x.taxon < y.taxon GROUP BY ALL),
dist AS (SELECT a, b, compared, equal, (compared - equal) / compared AS d FROM p)"""
ORACLE["p_distance"] = f"WITH {_DISTANCE} SELECT a, b, compared, equal, round(d, 6) AS distance FROM dist"


def _neighbor_joining(taxa: int) -> str:
    """Neighbour joining unrolled: one set of CTEs per possible join, idle once three taxa are left."""
    ctes = [_DISTANCE.strip(), "d0 AS MATERIALIZED (SELECT a, b, d FROM dist UNION ALL SELECT b, a, d FROM dist)"]
    for i in range(taxa - 3):
        ctes += [
            f"n{i} AS MATERIALIZED (SELECT count(DISTINCT a) AS n FROM d{i})",
            f"r{i} AS MATERIALIZED (SELECT a, sum(d) AS r FROM d{i} GROUP BY a)",
            f"b{i} AS MATERIALIZED (SELECT x.a, x.b, x.d, p.r AS ra, q.r AS rb, n FROM d{i} x JOIN r{i} p ON p.a = x.a "
            f"JOIN r{i} q ON q.a = x.b, n{i} WHERE x.a < x.b AND n > 3 "
            "ORDER BY round((n - 2) * x.d - p.r - q.r, 12), x.a, x.b LIMIT 1)",
            f"e{i} AS (SELECT a AS node, 'inner_{i}' AS parent, d / 2 + (ra - rb) / (2 * (n - 2)) AS length FROM b{i} UNION ALL "
            f"SELECT b, 'inner_{i}', d / 2 - (ra - rb) / (2 * (n - 2)) FROM b{i})",
            f"f{i} AS MATERIALIZED (SELECT x.b AS k, (sum(x.d) - any_value(b{i}.d)) / 2 AS d FROM d{i} x, b{i} "
            f"WHERE x.a IN (b{i}.a, b{i}.b) AND x.b NOT IN (b{i}.a, b{i}.b) GROUP BY x.b)",
            f"d{i + 1} AS MATERIALIZED (SELECT a, b, d FROM d{i} WHERE a NOT IN (SELECT unnest([a, b]) FROM b{i}) "
            f"AND b NOT IN (SELECT unnest([a, b]) FROM b{i}) UNION ALL SELECT 'inner_{i}', k, d FROM f{i} "
            f"UNION ALL SELECT k, 'inner_{i}', d FROM f{i})",
        ]
    last = f"d{taxa - 3}"
    edges = " UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(taxa - 3))
    return f"""WITH {', '.join(ctes)},
joined AS (SELECT * FROM ({edges})),
root AS (SELECT 'inner_' || count(DISTINCT parent) AS root FROM joined),
ends AS (SELECT x.a AS node, root AS parent, (x.d + y.d - z.d) / 2 AS length FROM {last} x JOIN {last} y ON y.a = x.a AND y.b > x.b
  JOIN {last} z ON z.a = x.b AND z.b = y.b, root),
tree AS MATERIALIZED (SELECT * FROM joined UNION ALL SELECT * FROM ends UNION ALL SELECT root, NULL, 0.0 FROM root)"""


ORACLE["nj_edges"] = _neighbor_joining(25) + " SELECT node, parent, round(length, 6) AS length FROM tree"
# The longest way between two tips, walked from every tip; the tree hangs from the middle of it.
ORACLE["midpoint_rooted"] = _neighbor_joining(25).replace("WITH", "WITH RECURSIVE", 1) + """,
way AS MATERIALIZED (SELECT node AS u, parent AS v, length AS w FROM tree WHERE parent IS NOT NULL
  UNION ALL SELECT parent, node, length FROM tree WHERE parent IS NOT NULL),
tip AS (SELECT node FROM tree WHERE node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)),
walk AS (SELECT node AS s, node AS u, '' AS past, CAST(0 AS DOUBLE) AS d FROM tip
  UNION ALL SELECT s, way.v, walk.u, d + w FROM walk JOIN way ON way.u = walk.u WHERE way.v <> past),
longest AS MATERIALIZED (SELECT s, u AS t, d FROM walk WHERE u IN (SELECT node FROM tip) ORDER BY d DESC, s LIMIT 1),
path AS MATERIALIZED (SELECT x.u AS node, x.d AS place, lead(x.u) OVER (ORDER BY x.d) AS next, lead(x.d) OVER (ORDER BY x.d) AS next_place, l.d / 2 AS half
  FROM longest l JOIN walk x ON x.s = l.s JOIN walk y ON y.s = l.t AND y.u = x.u WHERE abs(x.d + y.d - l.d) < 1e-9),
middle AS MATERIALIZED (SELECT * FROM path WHERE place < half AND next_place >= half),
hung AS (SELECT node, 'midpoint' AS parent, half - place AS length FROM middle UNION ALL SELECT next, 'midpoint', next_place - half FROM middle
  UNION ALL SELECT way.v, way.u, way.w FROM hung JOIN way ON way.u = hung.node, middle
  WHERE way.v <> hung.parent AND NOT (way.u = middle.node AND way.v = middle.next) AND NOT (way.u = middle.next AND way.v = middle.node))
SELECT node, parent, round(length, 6) AS length FROM hung UNION ALL SELECT 'midpoint', NULL, 0.0"""

# ---- families ------------------------------------------------------------------------------

_TOKENS = "tokens AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS family, source AS strain, doc_id FROM documents)"
_EVENT = "tokens AS (SELECT concat_ws('|', json_extract_string(props, '$.k'), hour(ts)) AS family, event_type AS strain FROM events)"
_FAMILIES = """
total AS (SELECT count(DISTINCT strain) AS n FROM tokens),
fam AS (SELECT family, count(DISTINCT strain) AS n_genomes, count(*) AS n_proteins FROM tokens GROUP BY family),
families AS (SELECT family, n_genomes, n_proteins, CASE WHEN n_genomes = n THEN 'core' WHEN n_genomes >= 0.95 * n THEN 'soft-core'
  WHEN n_genomes = 1 THEN 'unique' ELSE 'accessory' END AS class FROM fam, total)"""
ORACLE["family_stats"] = f"WITH {_TOKENS}, {_FAMILIES} SELECT * FROM families"
ORACLE["class_partition"] = f"""WITH {_TOKENS}, {_FAMILIES},
c AS (SELECT * FROM (VALUES (0, 'core'), (1, 'soft-core'), (2, 'accessory'), (3, 'unique')) v(rank, class))
SELECT CAST(rank AS BIGINT) AS rank, c.class, count(family) AS n_families,
  round(count(family) / (SELECT count(*) FROM families), 6) AS share FROM c LEFT JOIN families f ON f.class = c.class GROUP BY 1, 2"""
ORACLE["presence_matrix"] = f"""WITH {_TOKENS},
pairs AS (SELECT DISTINCT family, strain FROM tokens)
SELECT f.family, concat_ws('=', s.strain, CASE WHEN p.family IS NULL THEN '0' ELSE '1' END) AS strain
FROM (SELECT DISTINCT family FROM pairs) f CROSS JOIN (SELECT DISTINCT source AS strain FROM documents) s
LEFT JOIN pairs p ON p.family = f.family AND p.strain IS NOT DISTINCT FROM s.strain"""
ORACLE["presence_cells"] = f"""WITH {_TOKENS}
SELECT f.family, s.strain, CAST(max(CASE WHEN t.strain IS NOT DISTINCT FROM s.strain THEN 1 ELSE 0 END) AS INTEGER) AS present
FROM (SELECT DISTINCT family FROM tokens) f CROSS JOIN (SELECT DISTINCT strain FROM tokens) s JOIN tokens t ON t.family = f.family GROUP BY ALL"""
ORACLE["family_alignment"] = """
SELECT p_brand AS family, p_partkey AS strain, replace(concat_ws(' ', p_name, p_type), '-', '') AS residues, true AS equal_width, true AS not_under_star FROM part"""
ORACLE["family_representative"] = """
SELECT source AS family, doc_id AS gene_key, CAST(length(text) AS BIGINT) AS length_aa FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) = 1"""
ORACLE["single_copy_core"] = f"""WITH {_EVENT}, {_FAMILIES}
SELECT family, n_genomes, n_proteins, n_proteins = n_genomes AS single_copy FROM families WHERE class = 'core'"""
ORACLE["core_gene_stats"] = f"""WITH {_EVENT}, {_FAMILIES}
SELECT count(*) AS n_families, max(n_genomes) AS n_genomes, CAST(count_if(class = 'core') AS BIGINT) AS core_families,
  CAST(count_if(class = 'core' AND n_proteins = n_genomes) AS BIGINT) AS single_copy_families FROM families"""
ORACLE["core_sequences"] = """
WITH s AS (SELECT l_partkey AS family, l_returnflag AS strain, CAST(l_suppkey AS VARCHAR) AS seq FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey * 8 + l_linenumber DESC) = 1)
SELECT family, strain, seq FROM s
WHERE family IN (SELECT family FROM s GROUP BY family HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem))"""
ORACLE["annotation_rate"] = f"""WITH {_TOKENS}, {_FAMILIES},
known AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS k FROM benchmark)
SELECT class, count(*) AS n_families, count(k) AS n_annotated, round(count(k) / count(*), 6) AS rate
FROM families LEFT JOIN known ON k = family GROUP BY class"""
ORACLE["functional_annotation"] = f"""WITH {_TOKENS}, {_FAMILIES},
words AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS family,
  unnest(range(0, len(regexp_extract_all(lower(text), '[a-z]+')))) AS ord FROM benchmark),
hits AS (SELECT family, 'item' || item_id AS pfam, min(ord) AS ord FROM words WHERE ord * 1e-7 <= 1e-5 GROUP BY ALL)
SELECT family, pfam, upper(family) AS description, round(ord * 1e-7, 8) AS i_evalue, CAST(length(family) AS BIGINT) AS score, class
FROM hits LEFT JOIN families USING (family)"""
ORACLE["best_domain"] = """
SELECT l_suppkey AS family, p_type AS pfam, p_name AS description, round(l_tax / 4000, 8) AS i_evalue, l_quantity AS score
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' AND l_tax / 4000 <= 1e-5
QUALIFY row_number() OVER (PARTITION BY l_suppkey, p_type ORDER BY l_orderkey * 8 + l_linenumber) = 1"""

# ---- statistics ----------------------------------------------------------------------------

_COUNTS = """
fam AS (SELECT doc_id, {label} = 1 AS variable FROM labels),
total AS (SELECT count_if(variable) AS v, count_if(NOT variable) AS k FROM fam),
dom AS (SELECT DISTINCT family AS pfam, doc_id FROM tokens),
counted AS (SELECT pfam, count_if(variable) AS a, count_if(NOT variable) AS c FROM dom JOIN fam USING (doc_id) GROUP BY pfam),
counts AS (SELECT pfam, upper(pfam) AS description, CAST(a AS BIGINT) AS n_accessory, CAST(v - a AS BIGINT) AS b,
  CAST(c AS BIGINT) AS n_core, CAST(k - c AS BIGINT) AS d FROM counted, total)"""


def _choose(n: str, k: str) -> str:
    return f"lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"


ORACLE["enrichment_counts"] = f"WITH {_TOKENS}, {_COUNTS.format(label='toxic')} SELECT * FROM counts"
_FISHER = f"""WITH {_TOKENS}, {_COUNTS},
tables AS (SELECT DISTINCT n_accessory AS a, b, n_core AS c, d FROM counts),
tail AS (SELECT a, b, c, d, unnest(range(a, least(a + b, a + c) + 1)) AS i FROM tables),
tested AS (SELECT a, b, c, d, least(sum(exp({_choose('(a + c)', 'i')} + {_choose('(b + d)', '(a + b - i)')}
  - ({_choose('(a + b + c + d)', '(a + b)')}))), 1) AS p FROM tail GROUP BY ALL),
scored AS (SELECT pfam, description, n_accessory, n_core, p, CASE WHEN counts.b * n_core > 0
  THEN n_accessory * counts.d / (counts.b * n_core) WHEN n_accessory * counts.d > 0 THEN 1e9 END AS odds
  FROM counts JOIN tested t ON t.a = n_accessory AND t.c = n_core),
levels AS (SELECT p, count(*) AS m FROM scored GROUP BY p),
ranked AS (SELECT p, p * (SELECT count(*) FROM scored) / sum(m) OVER (ORDER BY p) AS raw FROM levels),
stepped AS (SELECT p, least(min(raw) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q FROM ranked)
SELECT pfam, description, n_accessory, n_core, round(odds, 6) AS odds_ratio, round(scored.p, 6) AS p_value, round(q, 6) AS q_value
FROM scored JOIN stepped USING (p)"""
for _name, _label in (("fisher_enrichment", "toxic"), ("fisher_quality", "quality")):
    ORACLE[_name] = _FISHER.format(label=_label)
ORACLE["bh_fdr"] = """
WITH t AS (SELECT o_orderkey, round(pow(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) / pow(2.0, 60), 3), 5) AS p FROM orders),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, o_orderkey) AS raw FROM t),
s AS (SELECT o_orderkey, p, least(min(raw) OVER (ORDER BY p, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q FROM r)
SELECT o_orderkey, p AS p_value, round(q, 6) AS q_value, q < 0.05 AS significant FROM s"""

# ---- presence over isolates ----------------------------------------------------------------

_MARKED = "(" + " OR ".join(f"contains(lower({{0}}), '{m.replace(chr(39), chr(39) * 2)}')" for m in INTRINSIC_MARKERS) + ")"
_PRESENCE = f"""
presence AS (SELECT DISTINCT concat_ws('|', p_brand, p_type, p_partkey) AS gene, l_suppkey AS s, 's' || l_suppkey AS strain FROM lineitem
  JOIN part ON l_partkey = p_partkey WHERE {GENE_HIT}),
replicons AS (SELECT DISTINCT p_type AS replicon, 's' || l_suppkey AS strain FROM lineitem
  JOIN part ON l_partkey = p_partkey WHERE {REPLICON_HIT}),
meta AS (SELECT 's' || s_suppkey AS strain, r_name AS host_group, CASE WHEN s_acctbal > 0 THEN n_name END AS serovar, s_name AS country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
totals AS (SELECT gene, NOT {_MARKED.format('gene')} AS acquired, count(*) AS n_isolates, count(DISTINCT host_group) AS n_hosts
  FROM presence LEFT JOIN meta USING (strain) GROUP BY gene)"""
ORACLE["gene_carriers"] = f"WITH {_PRESENCE} SELECT gene, n_isolates, n_hosts, acquired FROM totals"
ORACLE["sharing_matrix"] = f"""WITH {_PRESENCE}
SELECT gene, {', '.join(f'''count_if(host_group = '{r}')::BIGINT AS "{r}"''' for r in REGIONS)},
  count(DISTINCT host_group) AS n_hosts, NOT {_MARKED.format('gene')} AS acquired
FROM presence LEFT JOIN meta USING (strain) GROUP BY gene"""
ORACLE["isolate_summary"] = f"""WITH {_PRESENCE},
g AS (SELECT strain, count(*) AS n_amr, CAST(count_if(NOT {_MARKED.format('gene')}) AS BIGINT) AS n_acquired,
  string_agg(gene, ', ' ORDER BY gene) AS genes FROM presence GROUP BY strain),
p AS (SELECT strain, string_agg(replicon, ', ' ORDER BY replicon) AS replicons FROM replicons GROUP BY strain)
SELECT strain, host_group, serovar, country, n_amr, n_acquired, genes, coalesce(replicons, '') AS replicons
FROM g LEFT JOIN meta USING (strain) LEFT JOIN p USING (strain)"""
ORACLE["hit_report"] = f"""
SELECT p_type AS database, count(*) AS n_hits, count(DISTINCT p_brand) AS n_genes,
  count(DISTINCT CASE WHEN NOT {_MARKED.format('p_brand')} THEN p_brand END) AS n_acquired,
  count(DISTINCT CASE WHEN {_MARKED.format('p_brand')} THEN p_brand END) AS n_intrinsic, count(DISTINCT l_suppkey) AS n_isolates
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type"""
ORACLE["top_genes"] = f"WITH {_PRESENCE} SELECT gene, count(*) AS n_isolates FROM presence GROUP BY gene ORDER BY 2 DESC, 1 LIMIT 5"
ORACLE["cooccurrence"] = f"""WITH {_PRESENCE}
SELECT gene, replicon, count(*) AS n_isolates FROM presence JOIN replicons USING (strain) GROUP BY ALL"""

# ---- tree ----------------------------------------------------------------------------------

_TREE = """
tips AS (SELECT 's' || s_suppkey AS tip, 'n' || s_nationkey AS n, 'r' || n_regionkey AS r
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _fitch(labelled: str, mark: str = "") -> str:
    """Three unrolled levels over a dense 0/1 labelling ``(grp, tip, n, r, state)``."""
    def level(name: str, source: str, keys: str) -> str:
        return (f"{name}_m AS (SELECT grp, {keys} bit_and(mask) AS cap, bit_or(mask) AS cup, sum(chg) AS chg FROM {source} "
                f"GROUP BY grp{', ' + keys.rstrip(', ') if keys else ''}), {name} AS (SELECT grp, {keys} "
                f"CASE WHEN cap <> 0 THEN cap ELSE cup END AS mask, chg + CASE WHEN cap = 0 THEN 1 ELSE 0 END AS chg FROM {name}_m)")
    leaf = f"leaf AS (SELECT grp, n, r, CASE WHEN state = 1 THEN 2 ELSE 1 END AS mask, 0 AS chg FROM {labelled})"
    return ", ".join([leaf, level(f"nat{mark}", "leaf", "n, r, "), level(f"reg{mark}", f"nat{mark}", "r, "), level(f"top{mark}", f"reg{mark}", "")])


_OBSERVED = """
genes AS (SELECT DISTINCT gene FROM presence),
labelled AS (SELECT genes.gene AS grp, tip, n, r, CASE WHEN p.gene IS NULL THEN 0 ELSE 1 END AS state
  FROM genes CROSS JOIN tips LEFT JOIN presence p ON p.gene = genes.gene AND p.strain = tip)"""
ORACLE["tree_shape"] = f"""WITH {_TREE},
edges AS (SELECT tip AS node, n AS parent, 3 AS depth FROM tips UNION ALL SELECT DISTINCT n, r, 2 FROM tips
  UNION ALL SELECT DISTINCT r, 'root', 1 FROM tips UNION ALL SELECT DISTINCT 'root', NULL, 0 FROM tips),
kids AS (SELECT parent, count(*) AS n FROM edges GROUP BY parent)
SELECT node, edges.parent, coalesce(kids.n, 0) AS n_children, CAST(depth AS BIGINT) AS depth, kids.n IS NULL AS is_tip
FROM edges LEFT JOIN kids ON kids.parent = node"""
ORACLE["fitch_score"] = f"WITH {_TREE}, {_PRESENCE}, {_OBSERVED}, {_fitch('labelled')} SELECT grp AS gene, CAST(chg AS BIGINT) AS changes FROM top"
_CLUMPING = f"""{_TREE}, {_PRESENCE}, {_OBSERVED}, {_fitch('labelled')},
size AS (SELECT count(*) AS t FROM tips),
obs AS (SELECT grp AS gene, any_value(top.chg) AS o, sum(state) AS k,
  CASE WHEN sum(state) BETWEEN 1 AND any_value(t) - 1 THEN least(sum(state), any_value(t) - sum(state)) END AS small
  FROM labelled JOIN top USING (grp), size GROUP BY grp),
sizes AS (SELECT DISTINCT small FROM obs WHERE small IS NOT NULL),
drawn AS (SELECT tip, n, r, perm, row_number() OVER (PARTITION BY perm ORDER BY md5('{SEED}|' || perm || '|' || tip), tip) AS rk
  FROM tips, range({PERMUTATIONS}) t(perm)),
p_lab AS (SELECT small * 100000 + perm AS grp, n, r, CASE WHEN rk <= small THEN 1 ELSE 0 END AS state FROM drawn, sizes),
p_leaf AS (SELECT grp, n, r, CASE WHEN state = 1 THEN 2 ELSE 1 END AS mask FROM p_lab),
p_nat AS (SELECT grp, n, r, bit_and(mask) AS cap, bit_or(mask) AS cup FROM p_leaf GROUP BY grp, n, r),
p_reg AS (SELECT grp, r, bit_and(CASE WHEN cap <> 0 THEN cap ELSE cup END) AS cap, bit_or(CASE WHEN cap <> 0 THEN cap ELSE cup END) AS cup,
  count_if(cap = 0) AS chg FROM p_nat GROUP BY grp, r),
p_top AS (SELECT grp, bit_and(CASE WHEN cap <> 0 THEN cap ELSE cup END) AS cap, sum(chg) + count_if(cap = 0) AS chg FROM p_reg GROUP BY grp),
nulls AS (SELECT grp // 100000 AS small, chg + CASE WHEN cap = 0 THEN 1 ELSE 0 END AS s FROM p_top),
tests AS (SELECT gene, CAST(k AS BIGINT) AS n_tips, CAST(any_value(o) AS BIGINT) AS changes_observed, avg(s) AS changes_expected,
  CASE WHEN any_value(obs.small) IS NOT NULL THEN (count_if(s <= o) + 1) / ({PERMUTATIONS} + 1) END AS p_clumped
  FROM obs LEFT JOIN nulls ON nulls.small = obs.small GROUP BY gene, k)"""
ORACLE["permutation_null"] = f"""WITH {_CLUMPING}
SELECT gene, n_tips, changes_observed, round(changes_expected, 4) AS changes_expected, round(p_clumped, 6) AS p_clumped FROM tests"""


def _exact(most: int) -> str:
    """All placements counted: tips by nation in closed form, then nations of a region and regions one after another."""
    def choose(n: str, k: str) -> str:
        return f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"

    def fold(name: str, source: str, key: str, above: str) -> list[str]:
        group = f"{above}, " if above else ""
        same = f"AND x.{above} = y.{above}" if above else ""
        ctes = [f"{name}_o AS MATERIALIZED (SELECT *, dense_rank() OVER ({f'PARTITION BY {above} ' if above else ''}ORDER BY {key}) AS o FROM {source})",
                f"{name}_1 AS MATERIALIZED (SELECT {group}1 AS o, k, s, mask AS cap, mask AS cup, w FROM {name}_o WHERE o = 1)"]
        for i in range(2, most + 1):
            pre = f"{name}_{i - 1}"
            ctes.append(
                f"{name}_{i} AS MATERIALIZED (SELECT {'x.' + above + ', ' if above else ''}{i} AS o, x.k + y.k AS k, x.s + y.s AS s, x.cap & y.mask AS cap, "
                f"x.cup | y.mask AS cup, sum(x.w * y.w) AS w FROM {pre} x JOIN {name}_o y ON y.o = {i} AND x.o = {i - 1} {same} GROUP BY ALL UNION ALL "
                f"SELECT {'x.' + above + ', ' if above else ''}x.o, k, s, cap, cup, w FROM {pre} x WHERE NOT EXISTS (SELECT 1 FROM {name}_o y WHERE y.o = {i} AND x.o = {i - 1} {same}))")
        ctes.append(f"{name} AS MATERIALIZED (SELECT {group}k, s + CASE WHEN cap = 0 THEN 1 ELSE 0 END AS s, CASE WHEN cap = 0 THEN cup ELSE cap END AS mask, "
                    f"sum(w) AS w FROM {name}_{most} GROUP BY ALL)")
        return ctes

    leaf = (f"nat AS MATERIALIZED (SELECT r, n, k, CASE WHEN k > 0 AND k < t THEN 1 ELSE 0 END AS s, CASE WHEN k = 0 THEN 1 WHEN k = t THEN 2 ELSE 3 END AS mask, "
            f"{choose('t', 'k')} AS w FROM (SELECT r, n, t, unnest(range(0, t + 1)) AS k FROM (SELECT r, n, count(*) AS t FROM tips GROUP BY r, n)))")
    return ", ".join([_TREE.strip(), leaf, *fold("reg", "nat", "n", "r"), *fold("top", "reg", "r", ""),
                      "null_all AS MATERIALIZED (SELECT k, s AS changes, sum(w) / sum(sum(w)) OVER (PARTITION BY k) AS share FROM top GROUP BY k, s)"])


ORACLE["exact_null"] = f"""WITH {_exact(12)}
SELECT CAST(k AS BIGINT) AS k, CAST(changes AS BIGINT) AS changes, round(ln(share), 6) + 0.0 AS log_share FROM null_all"""
ORACLE["exact_test"] = f"""WITH {_exact(12)}, {_PRESENCE}, {_OBSERVED}, {_fitch('labelled', '_f')},
obs AS (SELECT grp AS gene, any_value(top_f.chg) AS o, sum(state) AS k FROM labelled JOIN top_f USING (grp) GROUP BY grp)
SELECT gene, CAST(k AS BIGINT) AS n_tips, CAST(o AS BIGINT) AS changes_observed,
  CASE WHEN k BETWEEN 1 AND (SELECT count(*) FROM tips) - 1 THEN round((SELECT sum(changes * share) FROM null_all z WHERE z.k = obs.k), 6) END AS changes_expected,
  CASE WHEN k BETWEEN 1 AND (SELECT count(*) FROM tips) - 1 THEN round((SELECT sum(share) FROM null_all z WHERE z.k = obs.k AND z.changes <= obs.o), 6) END AS p_clumped
FROM obs"""
_PATTERN = f"""{_CLUMPING},
called AS (SELECT gene, acquired, n_isolates, n_hosts, changes_observed, changes_expected, p_clumped,
  CASE WHEN n_isolates = 1 THEN 'single isolate (uninformative)' WHEN p_clumped IS NULL THEN 'invariant (no test)'
  WHEN p_clumped < 0.05 THEN 'clumped (inherited)' ELSE 'scattered (repeated acquisition)' END AS pattern
  FROM tests JOIN totals USING (gene))"""
ORACLE["pattern_call"] = f"""WITH {_PATTERN}
SELECT gene, acquired, n_isolates, n_hosts, changes_observed, round(changes_expected, 2) AS changes_expected,
  round(p_clumped, 4) AS p_clumped, pattern FROM called"""
ORACLE["pattern_counts"] = f"WITH {_PATTERN} SELECT pattern, count(*) AS n_genes FROM called GROUP BY pattern"
ORACLE["newick_roundtrip"] = f"""WITH {_TREE},
h AS (SELECT n, r, CAST('0x' || substr(md5(tip), 1, 15) AS BIGINT) AS k FROM tips)
SELECT count(*) AS n_tips, bit_xor(k) AS clade FROM h GROUP BY n UNION SELECT count(*), bit_xor(k) FROM h GROUP BY r
UNION SELECT count(*), bit_xor(k) FROM h UNION SELECT 1, k FROM h"""

# ---- identifiers, inputs, incremental runs -------------------------------------------------

ORACLE["parse_identifiers"] = r"""
WITH h AS (SELECT p_partkey, p_type || '(' || p_brand || ')_' || p_size || '__AC' || p_partkey AS rep,
  'gb|AC' || p_partkey || '|ARO:3' || p_partkey || '|' || p_name || ' [x]' AS card,
  'VFG' || p_partkey || '(gb|WP_' || p_partkey || ') (' || p_name || ') ' || p_type || ' [' || p_brand || ' (VF' || p_size || ') - '
  || p_type || ' (VFC' || p_size || ')] [y]' AS vf, p_name, p_type FROM part)
SELECT p_partkey, regexp_extract(rep, '^(.+?)_(\d+)_', 1) AS replicon, string_split(string_split(card, '|')[4], ' ')[1] AS gene,
  regexp_extract(card, 'ARO:\d+') AS aro, regexp_extract(vf, '\((gb\|[A-Za-z0-9._]+)\)', 1) AS vf_gene,
  '(' || p_name || ') ' || p_type AS product, p_type AS category, string_split(card, '|')[1] AS strain, replace(vf, ' ', '_') AS canonical
FROM h"""
ORACLE["marker_flag"] = f"WITH {_TOKENS} SELECT DISTINCT family AS gene, NOT {_MARKED.format('family')} AS acquired FROM tokens"
ORACLE["isolate_metadata"] = """
WITH d AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y')
  WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y-%m') WHEN o_totalprice > 1000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS c FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS strain, o_orderpriority AS host_group, c AS collection_date, CAST(substr(c, 1, 4) AS BIGINT) AS year,
  CASE length(c) WHEN 4 THEN 'year' WHEN 7 THEN 'month' WHEN 10 THEN 'day' END AS date_precision FROM d"""
_FILES = """
files AS (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS size_bytes, count(*) AS n_contigs FROM lineitem GROUP BY 1),
report AS (SELECT CAST(p_partkey AS VARCHAR) AS accession, p_partkey || '.fna' AS file, size_bytes, n_contigs,
  CASE WHEN size_bytes IS NULL THEN 'missing' ELSE 'cached' END AS status FROM part LEFT JOIN files ON l_partkey = p_partkey)"""
ORACLE["fetch_report"] = f"WITH {_FILES} SELECT * FROM report"
ORACLE["fetch_totals"] = f"""WITH {_FILES}
SELECT count(*) AS n_genomes, CAST(count_if(status IN ('ok', 'cached')) AS BIGINT) AS n_available,
  CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS total_bytes, CAST(sum(coalesce(n_contigs, 0)) AS BIGINT) AS n_contigs FROM report"""
ORACLE["resume_todo"] = "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"
ORACLE["resume_reused"] = "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"
ORACLE["proteins_roundtrip"] = """
WITH s AS (SELECT doc_id, lang, upper(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS seq FROM documents)
SELECT lang || '|gene' || doc_id AS gene_key, lang AS strain, CAST(length(seq) AS BIGINT) AS length_aa, md5(seq) AS protein FROM s WHERE length(seq) >= 30"""
ORACLE["metadata_roundtrip"] = """
SELECT 'GCA_' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '.1' AS strain, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS host_group,
  CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS country, CAST(NULL AS INTEGER) AS year FROM customer"""
ORACLE["aro_annotation"] = """
SELECT p_partkey, 'ARO:3' || p_partkey AS aro, split_part(p_name, ' ', 1) AS gene, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS drug,
  CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS mech, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS family FROM part"""
ORACLE["supermatrix_roundtrip"] = f"""
SELECT taxon, CAST(length(string_agg(text, '' ORDER BY line)) AS BIGINT) AS width, md5(upper(string_agg(text, '' ORDER BY line))) AS residues
FROM ({ORACLE["supermatrix"]}) GROUP BY taxon"""

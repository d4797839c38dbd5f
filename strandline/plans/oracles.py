"""SQL of the views for an independent engine, shared by the oracle statements."""

from __future__ import annotations

from strandline.plans.views import RECORD_LENGTH

FEAT = f"""feat AS (
    SELECT 'C' || l_suppkey AS record_id, CAST(l_suppkey AS INT) AS record_index, l_suppkey, l_partkey, l_linenumber, l_orderkey, p_partkey, p_size,
           ((l_orderkey * 8 + l_linenumber) * 200000 + l_partkey % 200000) * 64 + CAST(l_quantity AS INT) AS fi,
           CASE WHEN l_returnflag = 'N' THEN 'gene' ELSE 'CDS' END AS type,
           l_orderkey * 100 + l_linenumber * 7 + 1 AS st, l_orderkey * 100 + l_linenumber * 7 + CAST(l_quantity AS INT) * 30 AS en,
           CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS sd, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS sym,
           l_partkey % 3 = 0 AS compound, CAST(l_quantity AS BIGINT) * 30 AS span, CAST(l_quantity AS BIGINT) * 30 - CASE WHEN l_partkey % 3 = 0 THEN 10 ELSE 0 END AS len,
           l_orderkey * 100 + l_linenumber * 7 + (CAST(l_quantity AS BIGINT) * 30) // 2 AS half, l_partkey % 40 = 0 AS pseudo,
           l_orderkey || '_' || l_linenumber AS tag, p_name AS gene, p_brand || ' ' || p_type AS product, 'WP_' || l_orderkey AS protein_id,
           CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE upper(replace(p_name, ' ', '')) END AS translation, CAST(l_linenumber % 3 + 1 AS INT) AS codon_start,
           'K' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS ko, 'COG' || lpad(CAST(p_size AS VARCHAR), 4, '0') AS cog, 'PF' || lpad(CAST(p_partkey % 500 AS VARCHAR), 5, '0') AS pf,
           'GO:' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') AS go, 'UniRef:U' || p_partkey AS uniref,
           (l_suppkey % 6 + 1) || '.' || l_linenumber || '.1.' || (l_partkey % 20) AS ec, CASE WHEN l_suppkey % 2 = 0 THEN 'circular' ELSE 'linear' END AS topology
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SEQ = """seq AS (
    SELECT doc_id, source, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM documents)"""
LENGTH = RECORD_LENGTH


def code_rows() -> str:
    """(table_id, codon, aa, stop, family) of the tables that the views use."""
    from strandline.functions.sequence import code_table, stop_codons

    rows = []
    for t in (4, 11):
        table, stops = code_table(t), set(stop_codons(t))
        rows += [f"({t}, '{c}', '{a}', {str(c in stops).lower()}, {sum(x == a for x in table.values())})" for c, a in table.items()]
    return f"code(table_id, codon, aa, stop, family) AS (VALUES {', '.join(rows)})"

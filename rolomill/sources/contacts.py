"""The contact fixture that is derived from the customer and nation tables: one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST = ["Alice", "Bruno", "Chloe", "Diego", "Elena", "Farid", "Greta", "Hugo", "Ines", "Jonas", "Karin", "Liam", "Marta", "Nils", "Olga", "Pavel"]
LAST = ["Ander", "Bergh", "Castel", "Dumont", "Eriks", "Falken", "Grant", "Holm", "Ivers", "Jansen", "Kowal", "Lind", "Moreau", "Novak", "Orsini", "Petrov"]
END = ["berg", "dahl", "er", "ez", "feld", "grad", "i", "land", "man", "off", "quist", "ski", "son", "stein", "vic", "wood"]


def _pick(words: list[str], n: str) -> str:
    width = max(map(len, words)) + 1
    return f"trim(substr('{''.join(w.ljust(width) for w in words)}', CAST(1 + {width} * ({n}) AS INT), {width}))"


def _div(n: str, k: int) -> str:
    return f"CAST(floor({n} / {k}.0) AS INT)"


def contacts_sql(customer: str = "customer", nation: str = "nation") -> str:
    """row_id, the eight fields and source_file; some rows are copies of others, some fields are empty, null tokens or odd, some rows are empty."""
    blank = lambda x: f"CASE WHEN k % 50 = 49 THEN '' ELSE {x} END"
    return f"""
        SELECT k AS row_id,
            {blank(_pick(FIRST, "p % 16"))} AS first_name,
            {blank(_pick(LAST, _div("p", 16) + " % 16") + " || " + _pick(END, _div("p", 256) + " % 16") + " || CASE WHEN k % 5 = 4 THEN 's' ELSE '' END")} AS last_name,
            {blank("CASE k % 9 WHEN 0 THEN NULL WHEN 1 THEN ' nan ' ELSE 'Acme ' || n_name || ' Inc' END")} AS current_company,
            {blank("CASE k % 4 WHEN 0 THEN 'Sales Manager' WHEN 1 THEN ' Engineer' WHEN 2 THEN '' ELSE 'None' END")} AS role,
            {blank("CASE k % 4 WHEN 0 THEN 'https://www.linkedin.com/in/user' || p WHEN 1 THEN NULL WHEN 2 THEN ' www.site.org/u' || p ELSE 'https://LinkedIn.com/pub/user' || p END")} AS linkedin,
            {blank("CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'n/a' WHEN 3 THEN ' USER' || p || '@Acme.io ' WHEN 4 THEN 'user' || p || ' at acme dot io' ELSE 'user' || p || '@acme.io' END")} AS email,
            {blank("CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN '12-34' ELSE '+1 (555) ' || lpad(CAST(p % 1000 AS VARCHAR(9)), 3, '0') || '-' || lpad(CAST(" + _div("p", 1000) + " AS VARCHAR(9)), 4, '0') END")} AS phone,
            CASE WHEN k % 3 = 0 THEN '' ELSE n_name END AS geo,
            'list_' || (k % 3) || '.csv' AS source_file
        FROM (
            SELECT CAST(c_custkey AS BIGINT) AS k, CAST(CASE WHEN c_custkey % 5 = 4 THEN c_custkey - 4 WHEN c_custkey % 5 = 3 AND c_custkey % 2 = 1 THEN c_custkey - 3 ELSE c_custkey END AS INT) AS p, n_name
            FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey)"""


def contacts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers are dealt to all tasks first: their file is a single split up to some million rows."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customer = read("customer").select("c_custkey", "c_nationkey").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "c_custkey")
    return spark.sql(contacts_sql("{customer}", "{nation}"), customer=customer, nation=read("nation"))

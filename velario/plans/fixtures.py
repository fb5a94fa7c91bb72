"""Tables derived from the driver's tables by SQL that Spark and DuckDB read alike.

``@name`` stands for a driver table. Names and identifiers are arithmetic on keys: a tax id is
right unless its key leaves 2 mod 3, a personal id is right for even keys, every account number is.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_CONTROL = "(" + " + ".join(f"case when cast(substr(dg,{i},1) as int) > 4 then 2 * cast(substr(dg,{i},1) as int) - 9 else 2 * cast(substr(dg,{i},1) as int) end" if i % 2 else f"cast(substr(dg,{i},1) as int)" for i in range(1, 8)) + ")"


def _ids(table: str, key: str, group: str, salt: str) -> str:
    return f"""
      select k, code, name,
        concat('B', dg, case k % 3 when 0 then cast(cd as string) when 1 then substr('JABCDEFGHI', cast(cd + 1 as int), 1) else cast((cd + 1) % 10 as string) end) as cif,
        concat(nn, substr('TRWAGMYFPDXBNJZSQVHLCKE', cast((cast(nn as int) + (k % 2)) % 23 + 1 as int), 1)) as nif,
        concat('ES', lpad(cast(cast(98 - m as int) as string), 2, '0'), bb) as iban
      from (
        select *, (10 - ({_CONTROL} % 10)) % 10 as cd, cast(concat(bb, '142800') as decimal(38, 0)) % 97 as m
        from (
          select {key} as k, concat('{group}', lpad(cast({key} as string), 7, '0')) as code,
            concat(upper(translate(substr(md5(concat('{salt}', cast({key} as string))), 1, 8), '0123456789abcdef', 'bcdfghjklmnprstv')), ' ',
                   upper(translate(substr(md5(concat('{salt}', cast({key} as string))), 9, 8), '0123456789abcdef', 'bcdfghjklmnprstv')),
                   case {key} % 4 when 0 then ' S.L.' when 1 then ', S.A.' when 2 then ' SLU' else '' end) as name,
            lpad(cast(({key} * 7919) % 10000000 as string), 7, '0') as dg,
            lpad(cast(({key} * 104729) % 100000000 as string), 8, '0') as nn,
            lpad(cast({key} * 15485863 as string), 20, '0') as bb
          from @{table}) b) s"""


CLIENTS = _ids("customer", "c_custkey", "430", "")
SUPPLIERS = _ids("supplier", "s_suppkey", "410", "S")
IDS = f"select * from ({CLIENTS}) c union all select * from ({SUPPLIERS}) p"

#: Ledger rows: counterparties described in several ways, staff, banks and rows of no interest.
LEDGER = f"""
  select cast(code as bigint) as row_no, code, description from (
    select code, case k % 5 when 0 then name when 1 then concat(name, ' (', cif, ')') when 2 then concat(name, ', CIF ', cif)
                            when 3 then concat('Servicios profesionales ', name) else concat('  ', name, ' ') end as description from ({IDS}) i
    union all select concat('465', lpad(cast(k as string), 7, '0')), concat('Anticipo ', name) from ({CLIENTS}) c where k % 10 = 0
    union all select concat('572', lpad(cast(k as string), 7, '0')), concat(name, ' - ', iban) from ({SUPPLIERS}) s
    union all select concat('472', lpad(cast(k as string), 7, '0')), 'Hacienda IVA soportado' from ({SUPPLIERS}) s
    union all select concat('623', lpad(cast(k as string), 7, '0')), concat('Gasto ', name) from ({SUPPLIERS}) s
  ) l"""

#: Sentences around names and identifiers.
NOTES = f"""
  select k as id, code, name, concat(
    case k % 3 when 0 then 'Factura emitida a ' when 1 then 'El contrato con ' else 'Pago recibido de ' end, name,
    case k % 4 when 0 then concat(' por servicios. CIF: ', cif, ' del titular') when 1 then concat(' y referencia ', nif, ' sin mas') when 2 then concat(' en la cuenta IBAN ', iban, ' del banco')
               else concat(' con correo info', cast(k as string), '@', 'empresa', cast(k % 7 as string), '.es y fin') end) as text
  from ({CLIENTS}) c"""

#: Spellings of names: suffix, blanks and one letter changed.
VARIANTS = f"""
  select k, 'CLIENTE' as kind, name as original, case k % 4 when 0 then replace(name, ' S.L.', ' SL') when 1 then replace(name, ' ', '')
    when 2 then concat(substr(name, 1, 5), 'X', substr(name, 7)) else concat(name, ' S.L.') end as variant
  from ({CLIENTS}) c"""

#: A sheet in cell form: three title rows, a heading row, then name, tax id and amount.
CELLS = f"""
  select cast(k % 3 as bigint) as doc_id, 0 as sheet_ord, 'Hoja' as sheet, cast(5 + k as int) as "row", c.col as col, 's' as vtype,
    case c.col when 1 then code when 2 then name when 3 then cif else cast(k * 10 as string) end as value
  from ({CLIENTS}) x cross join (select 1 as col union all select 2 union all select 3 union all select 4) c
  union all
  select d.doc_id, 0, 'Hoja', h.r, h.col, 's', h.v
  from (select cast(0 as bigint) as doc_id union all select 1 union all select 2) d
  cross join (select 1 as r, 1 as col, 'Informe de prueba' as v union all select 4, 1, 'Subcuenta' union all select 4, 2, 'Nombre cliente'
              union all select 4, 3, 'CIF' union all select 4, 4, 'Saldo final') h"""


def for_duckdb(sql: str) -> str:
    return re.sub(r"@(\w+)", r"\1", sql)


def for_spark(sql: str) -> str:
    return re.sub(r"@(\w+)", r"velario_\1", sql).replace('"row"', "`row`")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The derived table over the Parquet tables of ``sf_dir``."""
    for table in set(re.findall(r"@(\w+)", sql)):
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").createOrReplaceTempView(f"velario_{table}")
    return spark.sql(for_spark(sql))

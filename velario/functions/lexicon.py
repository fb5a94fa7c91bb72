"""Word lists, code tables and labels that results depend on.

Everything in this module is a fixed value: kept as plain text, in natural order.
"""

from __future__ import annotations

#: Company suffixes in the order in which they are tried.
SOCIETY_SUFFIXES = (
    "s.l.u.", "s.l.u", "slu", "s.a.u.", "s.a.u", "sau", "s.l.", "s.l", "sl", "s.a.", "s.a", "sa", "s.coop.", "scoop", "s.coop",
    "s.l.l.", "sll", "s.l.p.", "slp", "ltd.", "ltd", "limited", "inc.", "inc", "corp.", "corp", "corporation", "gmbh", "ag", "bv", "nv",
)

#: Words that are never names: headings, money terms, taxes, ledger terms, expenses, units.
_PLAIN_STOPWORDS = (
    "Compañía", "Compañia", "Empresa", "Sociedad", "Cliente", "Proveedor", "Contacto", "Email", "Dirección", "Direccion", "Teléfono",
    "Telefono", "CIF", "NIF", "IBAN", "Razón Social", "Concepto", "Comentario",
    "Ingresos", "Gastos", "EBITDA", "EBIT", "Resultado", "Margen", "Ventas", "Costes", "Coste", "Total", "Subtotal", "Beneficio",
    "Beneficios", "Pérdida", "Pérdidas", "Saldo", "Importe", "Cantidad", "Movimiento", "Movimientos", "Mvto", "Debe", "Haber", "Apertura",
    "Cierre", "Inicial", "Final", "Acumulado", "Periodo", "Período", "Ejercicio", "Trimestre", "Bimestre", "Semestre",
    "HP", "H.P.", "H.P", "HACIENDA", "Hacienda Pública", "Hacienda Publica", "SS", "S.S.", "Seguridad Social", "TGSS", "IS", "I.S.",
    "IRPF", "I.R.P.F.", "IVA", "I.V.A.", "IVA SOPORTADO", "IVA REPERCUTIDO", "REPERCUTIDO", "SOPORTADO", "IVA INTRACOMUNITARIO",
    "Intracomunitario", "Retención", "Retenciones", "Retencion",
    "Activo", "Pasivo", "Patrimonio", "Patrimonio Neto", "PN", "Inmovilizado", "Amortización", "Amortizacion", "Provisión", "Provision",
    "Existencias", "Tesorería", "Tesoreria", "Caja", "Bancos", "Capital", "Reservas", "Aplicación", "Aplicacion", "Aplazamientos",
    "Préstamos", "Prestamos", "Créditos", "Creditos", "Anticipo", "Anticipos",
    "Publicidad", "Propaganda", "Marketing", "Suministros", "Material", "Materiales", "Oficina", "Decoración", "Decoracion", "Mobiliario",
    "Tarjeta", "Tarjetas", "TPV", "Comisión", "Comision", "Comisiones", "Asesoría", "Asesoria", "Consultoría", "Consultoria", "Eventos",
    "Catering", "Ropa", "Real", "Casa", "Transporte", "Transportes", "TR", "Mob", "MOB", "Móvil",
    "Año", "Mes", "Fecha", "Día", "Dia", "Semana", "Profundidad", "Central", "Sucursal", "Delegación", "Delegacion", "Persona", "Personal",
    "Profesional", "Profesionales", "C empresas", "C Empresas", "Para Impto Sdades", "Sdades", "Sociedades", "Ganancia", "Ganancias",
    "Aplazamiento", "Coop", "S.Coop", "Fundación", "Fundacion",
    "Euros", "Euro", "€", "EUR", "Dólares", "Dolares", "USD", "Inmob", "Inmobiliaria", "Arte", "Arte Hortensia Herrero",
)
MONTHS = ("Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre")

#: Month column headings follow a rule: month-month in full and short form, and opening-month.
STOPWORDS = tuple(
    dict.fromkeys(
        w.lower()
        for w in (*_PLAIN_STOPWORDS, *(f"{m}-{m}" for m in MONTHS), *(f"{m[:3]}-{m[:3]}" for m in MONTHS), *(f"apertura-{m[:3]}" for m in MONTHS))
    )
)

#: First words of document references.
DOC_PREFIXES = (
    "factura", "facturas", "fact", "fac", "fra", "fras", "albaran", "albarán", "albaranes", "pedido", "pedidos", "presupuesto",
    "presupuestos", "ticket", "recibo", "recibos", "abono", "ref", "referencia", "asiento", "apunte", "documento", "nº", "núm", "num", "n.º",
)

#: Given names that mean nothing alone.
GIVEN_NAMES = (
    "juan", "maría", "maria", "josé", "jose", "antonio", "manuel", "francisco", "david", "daniel", "carlos", "javier", "pedro", "alejandro",
    "miguel", "pablo", "sergio", "jorge", "luis", "andrés", "andres", "rafael", "ángel", "angel", "adrián", "adrian", "diego", "iván", "ivan",
    "rubén", "ruben", "carmen", "ana", "isabel", "pilar", "cristina", "laura", "marta", "lucía", "lucia", "elena", "patricia", "sara", "andrea",
    "beatriz", "rocío", "rocio", "sandra", "carolina", "clara", "alba", "belén", "belen", "adriana", "ada", "natalia", "eva", "silvia", "raquel",
    "mónica", "monica", "nuria", "hortensia",
)

#: Ledger words that stick to the front of a company name, in the order tried.
ACCOUNTING_PREFIXES = (
    "Ingresos", "Gastos", "EBITDA", "EBIT", "Resultado", "Margen", "Ventas", "Costes", "Coste", "Cliente", "Proveedor", "Total", "Subtotal",
    "Importe", "Cantidad",
)

#: Chart-of-accounts groups by kind of counterparty.
ACCOUNT_GROUPS = {
    "CLIENTE": ("430", "431", "432", "433", "434", "435", "436", "437"),
    "PROVEEDOR": ("400", "401", "403", "404", "405", "406", "410", "411", "419"),
    "DEUDOR": ("440", "441", "446", "449"),
    "PERSONA": ("460", "465"),
    "GRUPO": ("450", "451", "452", "453", "550", "551"),
    "BANCO": ("572", "573", "574", "575", "576", "520"),
}
#: Public bodies: never replaced.
PUBLIC_ACCOUNTS = ("470", "471", "472", "473", "475", "476", "477", "479")

ACCOUNT_HEADS = (
    "cuenta", "código", "codigo", "cuenta contable", "cta", "subcuenta", "account", "código cuenta", "núm cuenta", "num cuenta", "n cuenta",
    "nº cuenta", "n.º cuenta", "código contable",
)
DESCRIPTION_HEADS = (
    "descripción", "descripcion", "concepto", "nombre", "denominación", "denominacion", "title", "description", "razón social",
    "razon social", "titular", "nombre cuenta", "nombre cta", "subcuenta nombre",
)
NUMERIC_HEADS = (
    "debe", "haber", "saldo", "saldo inicial", "saldo final", "saldo anterior", "saldo actual", "saldo periodo", "importe", "balance", "debit",
    "credit", "movimiento", "mvto", "mvto. debe", "mvto. haber", "movto debe", "movto haber", "acumulado debe", "acumulado haber",
    "total debe", "total haber",
)

#: Headings of name columns, most specific first.
NAME_HEADS = (
    ("CLIENTE", ("cliente", "clientes")),
    ("PROVEEDOR", ("proveedor", "proveedores", "acreedor", "acreedores")),
    ("DEUDOR", ("deudor", "deudores")),
    ("ORG", ("razón social", "razon social", "denominación social", "denominacion social", "denominación", "denominacion", "titular", "nombre fiscal", "contraparte")),
    ("ORG", ("nombre", "empresa", "sociedad", "entidad", "razón", "razon")),
)
NAME_HEAD_EXCLUDES = (
    "código", "codigo", "cod.", "cód.", " id", "id ", "nº", "n.º", "núm", "num", "tipo", "estado", "fecha", "importe", "saldo", "debe", "haber",
    "total", "teléfono", "telefono", "email", "correo", "cif", "nif", "iban", "dirección", "direccion", "postal", "población", "poblacion",
    "provincia", "país", "pais", "móvil", "movil", "cuenta",
)
#: "nombre de ..." counts as a name heading only with one of these.
NAME_OF_WORDS = ("cliente", "proveedor", "empresa", "razón", "razon", "fiscal", "social", "deudor", "acreedor")
GENERIC_VALUES = (
    "varios", "vario", "cliente", "clientes", "proveedor", "proveedores", "cliente contado", "contado", "cliente genérico", "cliente generico",
    "clientes varios", "proveedores varios", "otros", "otro", "varios clientes", "sin nombre", "n/a", "na", "ninguno", "no aplica", "-", "—",
    "varios proveedores",
)

LEGAL_KEYWORDS = (
    "arrendador", "arrendatario", "comprador", "vendedor", "partes contratantes", "cláusula primera", "clausula primera", "estipulaciones",
    "manifiestan que", "ambas partes", "non-disclosure agreement", "share purchase agreement", "confidentiality agreement", "spa",
    "letter of intent", "loi", "term sheet", "reunidos:", "comparecen", "ante mí, el notario",
)
TEASER_KEYWORDS = (
    "confidential information memorandum", "investment opportunity", "executive summary", "disclaimer", "non-binding", "highlights",
    "investment highlights", "cap table", "investor", "valoración", "múltiplo de ebitda", "transacciones comparables", "due diligence",
    "process letter", "proceso de venta", "teaser", "information memorandum",
)

#: Words before an identifier that make a failed checksum acceptable.
ID_LABELS = {
    "CIF": ("cif", "c.i.f", "c/c.i.f"),
    "NIF": ("nif", "nie", "dni", "n.i.f", "d.n.i"),
    "IBAN": ("iban", "cuenta", "cta", "c/c", "ccc"),
}

STRUCTURED_KINDS = ("CIF", "NIF", "IBAN", "ADDRESS", "EMAIL", "PHONE")
ORG_LIKE_KINDS = ("ORG", "CLIENTE", "PROVEEDOR", "DEUDOR", "GRUPO", "BANCO")
LEDGER_KINDS = ("CLIENTE", "PROVEEDOR", "DEUDOR", "PERSONA", "GRUPO", "BANCO")
UNIFIABLE_KINDS = ("ORG", "PER", "CLIENTE", "PROVEEDOR", "DEUDOR", "PERSONA", "GRUPO", "BANCO")

KIND_LABELS = {
    "ORG": "Empresa", "PER": "Persona", "CIF": "CIF", "NIF": "NIF/NIE", "IBAN": "IBAN", "ADDRESS": "Dirección", "EMAIL": "Email",
    "PHONE": "Teléfono", "CLIENTE": "Cliente (PGC 43x)", "PROVEEDOR": "Proveedor (PGC 40x/41x)", "DEUDOR": "Deudor (PGC 44x)",
    "PERSONA": "Persona/Personal (PGC 46x)", "GRUPO": "Empresa grupo (PGC 45x/55x)", "BANCO": "Banco (PGC 57x/52x)", "DOMINIO": "Dominio web",
}
#: (label, digits) of running placeholders: [Persona-1], [Cliente-001].
PLACEHOLDERS = {
    "PER": ("Persona", 1), "CIF": ("CIF", 1), "NIF": ("NIF", 1), "IBAN": ("IBAN", 1), "ADDRESS": ("Dirección", 1), "EMAIL": ("Email", 1),
    "PHONE": ("Teléfono", 1), "CLIENTE": ("Cliente", 3), "PROVEEDOR": ("Proveedor", 3), "DEUDOR": ("Deudor", 3), "PERSONA": ("Persona", 3),
    "GRUPO": ("Grupo", 3), "BANCO": ("Banco", 3), "DOMINIO": ("Dominio", 3),
}
ACCOUNT_LABELS = {"CLIENTE": "Cliente", "PROVEEDOR": "Proveedor", "DEUDOR": "Deudor", "PERSONA": "Persona", "GRUPO": "Grupo", "BANCO": "Banco"}
KIND_TO_TYPE = {
    "ORG": "Empresa", "CLIENTE": "Cliente", "PROVEEDOR": "Proveedor", "DEUDOR": "Deudor", "GRUPO": "Grupo", "BANCO": "Banco", "PER": "Persona",
    "PERSONA": "Persona", "ADDRESS": "Dirección", "EMAIL": "Email", "PHONE": "Teléfono", "CIF": "CIF/NIF", "NIF": "CIF/NIF", "IBAN": "IBAN",
    "DOMINIO": "Dominio web",
}
TYPE_TO_KIND = {
    "Empresa": "ORG", "Cliente": "CLIENTE", "Proveedor": "PROVEEDOR", "Deudor": "DEUDOR", "Grupo": "GRUPO", "Banco": "BANCO", "Persona": "PER",
    "Dirección": "ADDRESS", "Email": "EMAIL", "Teléfono": "PHONE", "CIF/NIF": "CIF", "IBAN": "IBAN", "Dominio web": "DOMINIO",
}

#: Fine labels of a model layer and the kind each stands for.
MODEL_LABEL_KINDS = {
    "PERSONA": "PER", "EMPRESA": "ORG", "EMPRESA_OBJETIVO": "ORG", "COMPRADOR": "ORG", "VENDEDOR": "ORG", "FONDO": "ORG", "BANCO": "BANCO",
    "ASESOR_MA": "ORG", "DESPACHO_LEGAL": "ORG", "AUDITOR": "ORG", "ACCIONISTA": "PER", "CEO": "PER", "CFO": "PER", "FOUNDER": "PER",
    "PROJECT_NAME": "ORG", "DEAL_NAME": "ORG", "MARCA": "ORG", "GRUPO_EMPRESARIAL": "GRUPO", "DOMINIO_WEB": "DOMINIO",
}
SERVICE_LABEL_KINDS = {"PERSON": "PER", "ORGANIZATION": "ORG"}

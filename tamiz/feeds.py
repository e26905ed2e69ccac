"""Feed contracts and target tables.

Fixed values: the column names, defaults, file-name prefixes, lengths and types
below are those of the files received and of the tables already in use.
"""

from __future__ import annotations

# --- contacts workbook ---------------------------------------------------------

CONTACT_COLUMNS = [
    "Id Gestion Campaña", "Tipo documento", "Número documento", "Nombre",
    "Fecha gestión", "Tipo llamada", "Código gestión", "Resultado",
    "Fecha Compromiso", "Funcionario", "Campaña", "Teléfono",
    "Obligación", "Nro. Comparendo", "Valor",
]

CONTACT_NAMES = {
    "Id Gestion Campaña": "id_gestion_campaña",
    "Tipo documento": "tipo_documento",
    "Número documento": "documento",
    "Nombre": "nombre_usuario",
    "Fecha gestión": "fecha_gestion",
    "Tipo llamada": "tipo_llamada",
    "Código gestión": "id_gestion",
    "Resultado": "resultado",
    "Fecha Compromiso": "fecha_compromiso",
    "Funcionario": "asesor",
    "Campaña": "campana",
    "Teléfono": "telefono",
    "Obligación": "obligacion",
    "Nro. Comparendo": "numero_comparendo",
    "Valor": "valor",
}

CONTACT_DEFAULTS = {
    "id_gestion_campaña": "sin registro",
    "tipo_documento": "sin registro",
    "nombre_usuario": "sin registro",
    "tipo_llamada": "Saliente",
    "campana": "SIN CAMPAÑA",
}

# --- messages workbook ---------------------------------------------------------

MESSAGE_COLUMNS = [
    "TIPO DOCUMENTO", "DOCUMENTO", "NOMBRE", "FECHA", "RESULTADO",
    "SMS", "BASE", "TELEFONO", "NRO_COMPARENDO",
]

MESSAGE_NAMES = {
    "TIPO DOCUMENTO": "tipo_documento",
    "DOCUMENTO": "documento",
    "NOMBRE": "nombre_usuario",
    "FECHA": "fecha_sms",
    "RESULTADO": "resultado",
    "SMS": "texto_sms",
    "BASE": "base",
    "TELEFONO": "telefono",
    "NRO_COMPARENDO": "numero_comparendo",
}

# The raw export of the message provider; note the swap of NOMBRES and NOMBRE.
MESSAGE_EXPORT_NAMES = {
    "DESC_DOCUMENTO": "TIPO DOCUMENTO",
    "NRO_COMPARENDO": "NRO COMPARENDO",
    "ID_USUARIO": "DOCUMENTO",
    "NOMBRES": "NOMBRE",
    "CELULAR 1": "TELEFONO",
    "SMS": "TEXTO",
    "NOMBRE": "BASE",
    "FECHA": "FECHA ENVIO",
    "RESULTADO SMS": "RESULTADO SMS",
}

EMPTY_DATE = "fecha_vacia"

# --- payment text files --------------------------------------------------------

AGREEMENT_PREFIX = "Ap pagados"
AGREEMENT_COLUMNS = [
    "nro_acuerdo", "id_usuario", "nombres", "apellidos", "valor",
    "fecha_liquida", "consecutivo_cuota",
]

TICKET_PREFIX = "Comparendos pagados"
TICKET_COLUMNS = [
    "nro_comparendo", "nro_recibo", "fecha_liquida_contrav", "compute_0004",
    "id_usuario", "nombres", "apellidos", "nro_resolucion", "intereses",
]

TEXT_SEPARATOR = "\t"
TEXT_ENCODING = "ISO-8859-1"

# --- target tables -------------------------------------------------------------

CONTACT_TARGET = {
    "id_registro": "varchar(64) not null",
    "id_gestion_campaña": "varchar(50)",
    "tipo_documento": "varchar(50)",
    "documento": "varchar(30) not null",
    "nombre_usuario": "varchar(100)",
    "fecha_gestion": "timestamp_ntz not null",
    "tipo_llamada": "varchar(50)",
    "id_gestion": "varchar(50) not null",
    "resultado": "varchar(100) not null",
    "fecha_compromiso": "date",
    "asesor": "varchar(100)",
    "campana": "varchar(50) not null",
    "telefono": "varchar(20)",
    "obligacion": "varchar(50)",
    "numero_comparendo": "varchar(50)",
    "valor": "decimal(12,2)",
    "identificador_infraccion": "varchar(50)",
    "archivo_origen": "varchar(100)",
    "fecha_carga": "timestamp default current_timestamp()",
}

MESSAGE_TARGET = {
    "id_registro": "varchar(64) not null",
    "tipo_documento": "varchar(50)",
    "documento": "varchar(30)",
    "nombre_usuario": "varchar(100)",
    "fecha_sms": "date not null",
    "resultado": "varchar(100)",
    "texto_sms": "varchar(250)",
    "base": "varchar(50)",
    "telefono": "varchar(20) not null",
    "numero_comparendo": "varchar(50)",
    "identificador_infraccion": "varchar(50)",
    "archivo_origen": "varchar(100)",
    "fecha_carga": "timestamp default current_timestamp()",
}

PAYMENT_TARGET = {
    "id_registro": "varchar(64) not null",
    "nro_acuerdo": "varchar(20)",
    "nro_comparendo": "varchar(50)",
    "documento": "varchar(20) not null",
    "nombre_usuario": "varchar(50) not null",
    "valor": "decimal(15,2) not null",
    "fecha_pago": "timestamp_ntz not null",
    "archivo_origen": "varchar(60) not null",
    "identificador_infraccion": "varchar(50)",
    "fecha_carga": "timestamp default current_timestamp()",
}

TARGETS = {"gestiones": CONTACT_TARGET, "sms": MESSAGE_TARGET, "pagos": PAYMENT_TARGET}


def lengths(target: dict[str, str]) -> dict[str, int]:
    """Longest text of each varchar column of a target."""
    return {
        c: int(t.split("(")[1].split(")")[0]) for c, t in target.items() if t.startswith("varchar")
    }


def mandatory(target: dict[str, str]) -> list[str]:
    return [c for c, t in target.items() if t.endswith("not null")]

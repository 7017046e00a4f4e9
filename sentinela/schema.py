"""Fixed names, schemas and texts shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns holding personal data, never kept after load.
PII_COLUMNS = [
    "NU_CPF", "NM_PACIENT", "NU_CNS", "NM_MAE_PAC", "NU_CEP", "NM_BAIRRO", "NM_LOGRADO",
    "NU_NUMERO", "NM_COMPLEM", "NU_DDD_TEL", "NU_TELEFON", "DT_NASC", "NOME_PROF", "REG_PROF",
]

# The cleaned case table, in order, with its column types.
CASE_TYPES = {
    "DT_SIN_PRI": "date", "DT_NOTIFIC": "date", "DT_DIGITA": "date", "DT_EVOLUCA": "date",
    "DT_INTERNA": "date", "DT_ENTUTI": "date", "DT_SAIDUTI": "date",
    "EVOLUCAO": "int", "HOSPITAL": "int", "UTI": "int", "CLASSI_FIN": "int",
    "VACINA_COV": "int", "VACINA": "int",
    "SG_UF": "string", "SG_UF_NOT": "string",
    "NU_IDADE_N": "int", "TP_IDADE": "int", "CS_SEXO": "string", "SEM_PRI": "int", "SEM_NOT": "int",
}
SELECTED_COLUMNS = list(CASE_TYPES)

ONSET = "DT_SIN_PRI"
GROWTH_DAYS = 7
GROWTH_DIGITS = 2
RATE_DIGITS = 4
DAILY_WINDOW_DAYS = 30
MONTHLY_WINDOW_DAYS = 365
MAX_NEWS_ITEMS = 5
MAX_ATTEMPTS = 3

METRIC_SCHEMA = T.StructType([
    T.StructField("metric_key", T.StringType()),
    T.StructField("component", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("computable", T.BooleanType()),
    T.StructField("numerator", T.LongType()),
    T.StructField("denominator", T.LongType()),
    T.StructField("period", T.StringType()),
    T.StructField("definition_ref", T.StringType()),
])

# Registry of the published metrics, in display order. `components` names the parts a
# metric is reported in; '' is a metric with a single part.
METRICS = {
    "case_growth_rate": {
        "components": [""],
        "needs": [ONSET],
        "name": "Taxa de aumento de casos",
        "definition": "(casos últimos 7 dias − casos 7 dias anteriores) / casos 7 dias anteriores × 100",
        "caveat": "Os últimos ~7–14 dias podem estar subnotificados (atraso de notificação).",
    },
    "mortality_rate": {
        "components": [""],
        "needs": [ONSET, "EVOLUCAO"],
        "name": "Taxa de mortalidade",
        "definition": (
            "óbitos / (óbitos + curas) usando EVOLUCAO (2=óbito por SRAG, 1=cura); "
            "EVOLUCAO=3 (óbito por outras causas) excluído do numerador e denominador"
        ),
        "caveat": (
            "Casos com EVOLUCAO=3 (óbito por outras causas) e EVOLUCAO=9 (ignorado) são excluídos "
            "do denominador."
        ),
    },
    "uti_admission_rate": {
        "components": [""],
        "needs": [ONSET, "UTI", "HOSPITAL"],
        "name": "Taxa de internação em UTI entre casos de SRAG",
        "definition": (
            "casos com UTI=1 (Sim) / total casos com HOSPITAL=1 (internados). Relabeled from 'taxa de "
            "ocupação' because the dataset supports admission rate only, not concurrent bed occupancy."
        ),
        "caveat": (
            "Reflete a proporção de casos hospitalizados que necessitaram de UTI, não a ocupação de leitos."
        ),
    },
    "vaccination_coverage": {
        "components": ["covid", "flu"],
        "needs": [ONSET, "HOSPITAL", "VACINA_COV", "VACINA"],
        "name": "Taxa de vacinação",
        "definition": (
            "Cobertura vacinal populacional via DATASUS/PNI por UF/período. Reportada separadamente para "
            "COVID-19 (VACINA_COV) e Influenza (VACINA)."
        ),
        "caveat": "Duas taxas separadas, uma por patógeno. Nunca conflacionadas em um único número.",
    },
}
METRIC_KEYS = list(METRICS)

# News domains accepted, by tier.
NEWS_DOMAINS = {
    "tier1_authoritative": ["fiocruz.br", "agencia.fiocruz.br", "gov.br"],
    "tier2_journalism": [
        "agenciabrasil.ebc.com.br", "g1.globo.com", "uol.com.br", "folha.uol.com.br", "estadao.com.br",
    ],
    "tier3_international": ["paho.org"],
}


def definition_ref(metric_key: str) -> str:
    """Versioned identifier of a metric definition."""
    return f"{metric_key}_v1"

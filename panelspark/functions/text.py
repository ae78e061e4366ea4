"""Prompt building and response parsing as column expressions (L1, L2)."""


from pyspark.sql import Column, DataFrame, functions as F

# The clinical prompt.  Placeholders are filled in this order:
# age_v1, mmse_v1, cdr_v1, nwbv_v1 (.4f), education_years, sex, mr_delay_v2, age_v2, mmse_v2,
# cdr_v2, nwbv_v2 (.4f), mmse_delta (+.1f), nwbv_delta (+.4f), cdr_delta (+.1f).
PROMPT_TEMPLATE = """You are a clinical AI assistant supporting an Alzheimer's disease trial.
A participant has completed two study visits. Based on their longitudinal
data below, predict whether their Clinical Dementia Rating (CDR) will
WORSEN by their final study visit.

Respond with only: "1" (CDR will worsen) or "0" (CDR will remain stable).

Participant data:

VISIT 1:
- Age: %s
- MMSE: %s
- CDR: %s
- Normalised Brain Volume (nWBV): %s
- Education (years): %s
- Sex: %s

VISIT 2 (approx. %s days later):
- Age: %s
- MMSE: %s
- CDR: %s
- Normalised Brain Volume (nWBV): %s

Change from visit 1 to visit 2:
- MMSE change: %s
- nWBV change: %s
- CDR change: %s

Prediction (1 = will worsen, 0 = will remain stable):"""


def _plain(c: str) -> Column:
    """Python ``str()`` of the value: ints as digits, doubles like 27.4 / 30.0, NULL as nan."""
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def py_fixed(c: Column, digits: int, plus: bool = False) -> Column:
    """Python ``format(x, ".<digits>f")`` (``plus``: ``"+.<digits>f"``) of a double column, on the JVM.

    Java's formatter rounds the shortest decimal form half-up (0.35 -> 0.4, 6.25 -> 6.3); Python rounds the exact binary
    value half-even (0.3, 6.2).  So the fraction, which is exact, is split into two parts whose products with 10**digits
    are exact too, and their distance from the half-way point decides, a tie by the last digit's parity.  NULL and NaN
    give ``nan``; from 2**53 on, where doubles are whole, the shortest digits are filled up with zeros."""
    x, scale = c.cast("double"), float(10 ** digits)
    a = F.abs(x)
    whole = F.floor(a)
    f = a - whole.cast("double")
    high = f * 134217729.0
    high = high - (high - f)                                   # the upper half of the fraction's bits
    low = f - high
    base = F.floor(high * scale)
    past = (high * scale - base.cast("double") - 0.5) + low * scale
    units = base + F.when(past > 0, 1).when(past < 0, 0).otherwise(F.pmod(base, F.lit(2)))
    carried = units >= int(scale)
    number = F.concat((whole + carried.cast("long")).cast("string"), F.lit("."),
                      F.lpad(F.when(carried, units - int(scale)).otherwise(units).cast("string"), digits, "0"))
    huge = F.concat(a.cast("decimal(38,0)").cast("string"), F.lit("." + "0" * digits))
    number = F.when(a < 2.0 ** 53, number).when(a < 1e38, huge).otherwise("inf")
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("+" if plus else "")
    return F.when(x.isNull() | F.isnan(x), "+nan" if plus else "nan").otherwise(F.concat(sign, number))


def _fmt(c: str, spec: str) -> Column:
    return py_fixed(F.col(c), int(spec[-2]), spec.startswith("%+"))


def clinical_prompt(features: DataFrame, template: str = PROMPT_TEMPLATE, out: str = "prompt") -> DataFrame:
    """L1: feature row -> fixed prompt text, on the JVM."""
    parts = [
        _plain("age_v1"), _plain("mmse_v1"), _plain("cdr_v1"), _fmt("nwbv_v1", "%.4f"),
        _plain("education_years"), F.coalesce(F.col("sex"), F.lit("nan")),
        _plain("mr_delay_v2"), _plain("age_v2"), _plain("mmse_v2"), _plain("cdr_v2"), _fmt("nwbv_v2", "%.4f"),
        _fmt("mmse_delta_v1_v2", "%+.1f"), _fmt("nwbv_delta_v1_v2", "%+.4f"), _fmt("cdr_delta_v1_v2", "%+.1f"),
    ]
    return features.withColumn(out, F.format_string(template, *parts))


# The characters Python's str.strip() removes (str.isspace()).
PY_WHITESPACE = r"\t\n\x0B\f\r \x1c-\x1f\x85\xa0  -     　"
STRIP_PATTERN = rf"^[{PY_WHITESPACE}]+|[{PY_WHITESPACE}]+$"


def parse_response(text: Column) -> tuple[Column, Column]:
    """L2: (prediction, parse_status).  Stripped text exactly '0'/'1' -> clean; else contains '1'
    -> 1, contains '0' -> 0 (noisy); else 0 (unparseable); NULL -> 0 (missing).  '1' is tested
    before '0', so '10' is 1."""
    s = F.regexp_replace(text, STRIP_PATTERN, "")
    pred = (F.when(text.isNull(), 0).when(s == "1", 1).when(s == "0", 0)
            .when(F.instr(s, "1") > 0, 1).when(F.instr(s, "0") > 0, 0).otherwise(0))
    status = (F.when(text.isNull(), "missing").when(s.isin("0", "1"), "clean")
              .when((F.instr(s, "1") > 0) | (F.instr(s, "0") > 0), "noisy").otherwise("unparseable"))
    return pred.cast("int"), status

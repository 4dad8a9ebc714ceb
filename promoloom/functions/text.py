"""Product-name expressions: pack weight, product, attributes, tokens.

Regular expressions run in Java with ``(?U)`` so that word borders, digits and
spaces follow Unicode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight styles and the patterns that recognise them.
BY_WEIGHT, IN_KG, IN_G, BARE_KG, BARE_G, NO_WEIGHT = (
    "весовой", "кг", "г", "голое-кг", "голое-г", "нет")
PACK_FRACTION = r"(?U)\b\d+\s*/\s*\d+\b"
SOLD_BY_WEIGHT = r"(?U)\bвес\b|весов"
KG_AMOUNT = r"(?U)(\d+(?:\.\d+)?)\s*кг"
G_AMOUNT = r"(?U)(\d+(?:\.\d+)?)\s*гр?\b"
BARE_DECIMAL = r"(?U)(?<![\d.])(\d\.\d+)(?![\d])"
BARE_INTEGER = r"(?U)(?<![\d.])(\d{2,4})(?![\d./])"
BARE_KG_RANGE = (0.02, 5.0)
BARE_G_RANGE = (50.0, 2000.0)

# Substring of the name -> product, first match wins.
PRODUCT_HEADS = {
    "имбирь": "имбирь",
    "анчоус": "анчоус",
    "хамса": "анчоус",
    "килька": "килька",
    "икра": "икра",
    "капуста": "морская капуста",
    "скумбрия": "скумбрия",
    "сельдь": "сельдь",
    "семга": "семга",
    "форель": "форель",
    "горбуша": "горбуша",
    "салака": "салака",
    "мойва": "мойва",
    "ставрида": "ставрида",
    "креветка": "креветка",
    "паштет": "паштет",
    "спред": "спред",
    "пресерв": "пресервы",
    "морепродукт": "морепродукты",
    "масло": "масло",
    "мидии": "мидии",
    "кальмар": "кальмар",
    "осьминог": "осьминог",
    "тунец": "тунец",
    "лосось": "лосось",
    "кета": "кета",
    "сардина": "сардина",
    "масляная": "масляная рыба",
    "масляной": "масляная рыба",
    "треска": "треска",
    "минтай": "минтай",
    "краб": "краб",
    "путассу": "путассу",
    "сайра": "сайра",
    "салат": "салат",
}

# Abbreviations in names and what they stand for.
ABBREVIATIONS = {
    "с/с": " слабосоленый ",
    "п/п": " пряного посола ",
    "пр/посола": " пряного посола ",
    "пр/п": " пряного посола ",
    "в/у": " вакуумная упаковка ",
    "в/м": " в масле ",
    "г/к": " горячего копчения ",
    "х/к": " холодного копчения ",
}

# Tokens that carry no meaning.
STOP_WORDS = ("кг", "г", "гр", "мл", "л", "шт", "для", "со", "в", "на", "и", "с", "из", "без",
              "от", "до")

# Attribute -> value -> substrings, first match wins.
ATTRIBUTES = {
    "processing": {
        "маринованный": ("маринован", "маринад"),
        "копченый": ("копчен", "горячего копчения", "холодного копчения", "г/к", "х/к"),
        "слабосоленый": ("слабосол", "малосол", "с/с"),
        "пряного посола": ("пряного посола", "п/п", "пр/посола"),
        "имитированная": ("имитирован", "аналогов"),
        "соленый": ("солен",),
        "вяленый": ("вялен", "сушен"),
    },
    "form": {
        "филе": ("филе",),
        "кусок": ("кусок", "куск"),
        "нарезка": ("нарезк",),
    },
    "packaging": {
        "стекло": ("стекл",),
        "пластик": ("пластик",),
        "банка": ("банк",),
        "тиромат": ("тиромат",),
        "вакуум": ("вакуум", "в/у"),
    },
    "colour": {
        "красный": ("красн",),
        "черный": ("черн",),
        "розовый": ("розов",),
        "белый": ("бел",),
    },
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_text(name: Column) -> Column:
    """Lower case with ё read as е; a missing name reads as empty."""
    return F.replace(F.lower(F.coalesce(name.cast("string"), F.lit(""))), F.lit("ё"), F.lit("е"))


def pack_weight(name: Column) -> Column:
    """Struct of the weight style (``method``) and the weight in ``grams``."""
    cleaned = F.regexp_replace(F.replace(fold_text(name), F.lit(","), F.lit(".")), PACK_FRACTION, " ")

    def amount(text: Column, pattern: str) -> Column:
        return F.regexp_extract(text, pattern, 1).try_cast("double")

    def found(text: Column) -> Column:
        return F.struct(text.rlike(SOLD_BY_WEIGHT).alias("loose"), amount(text, KG_AMOUNT).alias("kg"),
                        amount(text, G_AMOUNT).alias("g"), amount(text, BARE_DECIMAL).alias("dec"),
                        amount(text, BARE_INTEGER).alias("int"))

    # An out-of-range bare decimal ends the search: a bare integer is not tried.
    def choose(m: Column) -> Column:
        none = F.lit(None).cast("double")
        styles = [
            (m["loose"], BY_WEIGHT, none),
            (m["kg"].isNotNull(), IN_KG, m["kg"] * 1000.0),
            (m["g"].isNotNull(), IN_G, m["g"]),
            (m["dec"].between(*BARE_KG_RANGE), BARE_KG, m["dec"] * 1000.0),
            (m["dec"].isNotNull(), NO_WEIGHT, none),
            (m["int"].between(*BARE_G_RANGE), BARE_G, m["int"]),
            (F.lit(True), NO_WEIGHT, none),
        ]
        return F.coalesce(*[F.when(hit, F.struct(F.lit(style).alias("method"), grams.alias("grams")))
                            for hit, style, grams in styles])

    return let(cleaned, lambda text: let(found(text), choose))


def with_pack_weight(df: DataFrame, name: str = "name") -> DataFrame:
    """Add ``weight_method`` and ``weight_g`` read from the product name."""
    return (df.withColumn("_w", pack_weight(F.col(name)))
            .withColumns({"weight_method": F.col("_w.method"), "weight_g": F.col("_w.grams")})
            .drop("_w"))


def product_head(name: Column) -> Column:
    """Canonical product of a name, null when none is recognised."""
    return let(fold_text(name), _head_of)


def _head_of(text: Column) -> Column:
    return F.coalesce(*[F.when(text.contains(key), F.lit(product))
                        for key, product in PRODUCT_HEADS.items()])


def name_attributes(name: Column) -> Column:
    """Struct of product, processing, form, packaging and colour."""
    return let(fold_text(name), _attributes_of)


def _attributes_of(text: Column) -> Column:
    fields = [_head_of(text).alias("product")]
    for attribute, values in ATTRIBUTES.items():
        cases = []
        for value, parts in values.items():
            hit = text.contains(parts[0])
            for part in parts[1:]:
                hit = hit | text.contains(part)
            cases.append(F.when(hit, F.lit(value)))
        fields.append(F.coalesce(*cases).alias(attribute))
    return F.struct(*fields)


def name_tokens(name: Column, lemma: Callable[[Column], Column] | None = None) -> Column:
    """Sorted distinct meaningful tokens; ``lemma`` maps a token to its base form."""
    text = fold_text(name)
    for short, full in ABBREVIATIONS.items():
        text = F.replace(text, F.lit(short), F.lit(full))
    text = F.regexp_replace(text, r"(?U)\d+[.,]?\d*", " ")
    text = F.regexp_replace(text, r"(?U)[^a-zа-я\s]", " ")
    tokens = F.filter(F.split(F.trim(text), r"(?U)\s+"),
                      lambda w: (F.char_length(w) > 1) & ~w.isin(*STOP_WORDS))
    if lemma is not None:
        tokens = F.transform(tokens, lemma)
    return F.array_sort(F.array_distinct(tokens))


def normalized_name(name: Column, lemma: Callable[[Column], Column] | None = None) -> Column:
    return F.concat_ws(" ", name_tokens(name, lemma))


def word_roots(text: Column, length: int = 4) -> Column:
    """Distinct leading ``length`` letters of the words at least that long."""
    letters = F.regexp_replace(fold_text(text), r"(?U)[^a-zа-я\s/]", " ")
    words = F.filter(F.split(letters, r"(?U)[\s/]+"), lambda w: F.char_length(w) >= length)
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, length)))


def token_set_similarity(left: Column, right: Column, refine: bool = False) -> Column:
    """Similarity 0..100 of two token arrays.

    Shared tokens over all tokens (Dice), and 100 when one side holds the
    whole of the other.  ``refine`` also compares the unshared tokens
    letter by letter and keeps the better score.
    """
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right)
    dice = F.lit(200.0) * shared / total
    score = F.when(shared == 0, 0.0)
    if refine:
        a = F.concat_ws(" ", F.array_except(left, right))
        b = F.concat_ws(" ", F.array_except(right, left))
        longest = F.greatest(F.char_length(a), F.char_length(b))
        letters = F.when(longest > 0,
                         F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / longest)).otherwise(0.0)
        score = F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).when(shared == 0, letters)
        dice = F.greatest(dice, letters)
    return (score.when((shared == F.size(left)) | (shared == F.size(right)), 100.0)
            .otherwise(dice))


def attribute_score(query: Column, doc: Column) -> Column:
    """0 for different products, else 3 for the same product plus 1 per equal attribute."""
    qp, dp = query["product"], doc["product"]
    both = qp.isNotNull() & dp.isNotNull()
    extras = F.lit(0.0)
    for attribute in ATTRIBUTES:
        extras = extras + F.coalesce((query[attribute] == doc[attribute]).cast("double"), F.lit(0.0))
    return (F.when(both & (qp != dp), 0.0)
            .otherwise(F.when(both, 3.0).otherwise(0.0) + extras))

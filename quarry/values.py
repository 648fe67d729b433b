"""They decide results, so they are stated here as they have to be."""

# Words that mark a front-matter page.
SKIP_KEYWORDS = (
    "предисловие", "foreword", "preface",
    "содержание", "contents", "table of contents",
    "ответственные", "responsible", "authors",
    "контакты", "contacts", "contact information",
    "оглавление",
    "список", "list",
)

# Patterns that mark a front-matter page.
SKIP_PATTERNS = ("^ПРЕДИСЛОВИЕ", "^СОДЕРЖАНИЕ", "^ОГЛАВЛЕНИЕ", "^CONTENTS", "^FOREWORD", "^PREFACE", "ответственные за", "responsible for", "телефон|phone|email|@")

# Tags and the substrings that trigger them.
CONTEXT_TAGS = {
    "образование": ("школ", "обучен", "учащ", "студент"),
    "здравоохранение": ("медицин", "больниц", "здравоох"),
    "цифровизация": ("цифров", "информацион", "it", "икт"),
    "работа": ("занятост", "работ", "безработ"),
    "население": ("населен", "демограф"),
}

# Labels of the metadata suffix, and the text for an empty page.
METRICS_LABEL, GEO_LABEL, YEARS_LABEL, NO_TEXT = "показатели: ", "география: ", "годы: ", "нет текста"

# Prefixes of chunk ids, in order, and spaces that count as spaces in them.
ID_PREFIXES = ("ID:", "id:", "ID: ", "id: ", "chunk_id:", "chunk_id: ")
ID_SPACES = "\u00a0\u2009\u2000\u2001"

# Weights of metadata parts.
METADATA_WEIGHTS = {"geo": 0.35, "metrics": 0.30, "years": 0.20, "granularity": 0.05, "oked": 0.10}

# Limits and lists of the record checks.
MAX_CONTEXT, MAX_METRICS, GRANULARITIES = 256, 5, ("year", "quarter", "month", "day")

# Messages of the record checks.
MESSAGES = {
    "no_id": "chunk_id отсутствует",
    "same_id": "chunk_id '{}' дублируется",
    "context_type": "context должен быть строкой",
    "context_long": "context обрезан до 256 символов",
    "metrics_type": "metrics должен быть списком или null",
    "metrics_many": "metrics превышает 5 элементов",
    "metric_type": "metrics[{}] должен быть строкой",
    "metric_latin": "metrics[{}] '{}' не содержит кириллицу",
    "years_type": "years должен быть списком или null",
    "year_type": "years[{}] должен быть целым числом",
    "geo_type": "geo должен быть строкой или null",
    "granularity": "time_granularity '{}' не в списке",
}

# Token patterns. The first keeps Cyrillic words and numbers only.
TOKENS = {"cyrillic": r"[а-яёіў]+(?:[-%][а-яёіў]+)*|\d+", "unicode": r"\p{L}+(?:[-%]\p{L}+)*|\d+"}
CYRILLIC = r"[\u0400-\u04FF]"

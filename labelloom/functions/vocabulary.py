"""Word lists and patterns that decide results. All are fixed values."""

from __future__ import annotations

# Replacements of the matching form, in this order.
MATCH_REPLACEMENTS = [
    ("—", "-"), ("–", "-"), ("_", "-"), ("•", " "), ("·", " "), ("₹", " rs "), ("m.r.p", "mrp"), ("m.r.p.", "mrp"),
    ("n. qty", "net qty"), ("n/qty", "net qty"), ("n,qty", "net qty"), ("n qty", "net qty"), ("net wt", "net weight"),
    ("batch no.", "batch"), ("batch no", "batch"), ("b.no.", "batch"), ("b.no", "batch"), ("b no", "batch"), ("mfd.", "mfd"),
    ("mfg.", "mfg"), ("exp.", "exp"), ("use by", "use by"), ("@@", "@"), ("0cr", "ocr"),
]

# Replacements of the comparison form of fusion, in this order.
FUSION_REPLACEMENTS = [("₹", "rs "), ("rs.", "rs "), ("m.r.p.", "mrp "), ("m.r.p", "mrp "), ("kg.", "kg"), ("kgs", "kg"), ("licence", "license")]

# Declaration labels, in order of preference.
LABELS = {
    "mrp": ["mrp", "maximum retail price", "retail price", "max retail price"],
    "quantity": ["net quantity", "net qty", "net weight", "net wt"],
    "batch": ["batch number", "batch no", "batch", "lot number", "lot no", "lot"],
    "manufacturer": ["packed & marketed by", "packed and marketed by", "packed marketed by", "marketed by", "manufactured by", "manufactured for", "packed by", "manufacturer"],
    "manufacturing_date": ["packing date", "date of packing", "packed on", "pack date", "manufacturing date", "manufactured on", "manufacturing dt", "mfg date", "mfd", "mfg"],
    "expiry_date": ["use by date", "use by", "expiry date", "expiry", "expires on"],
    "best_before": ["best before"],
    "consumer": ["consumer care", "customer care", "consumer feedback", "consumer complaint", "customer service", "helpline", "contact us", "complaints", "feedback"],
    "licence": ["fssai", "fssal", "fsai", "fssai license", "fssai licence", "license no", "licence no", "lic no", "lic. no"],
    "ingredients": ["ingredients", "ingredient"],
    "nutrition": ["nutrition information", "nutritional information", "nutrition facts", "nutritional facts", "nutrition"],
    "veg_nonveg": ["vegetarian", "non vegetarian", "non-vegetarian", "veg", "non veg", "non-veg"],
}

# Words that are never a batch code.
NON_VALUE_WORDS = [
    "mrp", "batch", "lot", "net", "weight", "quantity", "mfd", "mfg", "expiry", "use", "by", "best", "before", "packing", "date",
    "manufactured", "manufacturing", "marketed", "packed", "manufacturer", "consumer", "customer", "care", "feedback", "fssai", "license", "lic",
]

# Unit spellings.
UNITS = {
    "kgs": "kg", "kilogram": "kg", "kilograms": "kg", "gm": "g", "gms": "g", "gram": "g", "grams": "g", "litre": "l", "litres": "l",
    "liter": "l", "liters": "l", "ltr": "l", "millilitre": "ml", "millilitres": "ml",
}
UNIT_PATTERN = "(kg|kgs|kilogram|kilograms|g|gm|gms|gram|grams|mg|ml|millilitre|millilitres|l|ltr|litre|litres|liter|liters)"

# Month spellings.
MONTHS = {
    "jan": "JAN", "january": "JAN", "feb": "FEB", "february": "FEB", "mar": "MAR", "march": "MAR", "apr": "APR", "april": "APR", "may": "MAY",
    "jun": "JUN", "june": "JUN", "jul": "JUL", "july": "JUL", "aug": "AUG", "august": "AUG", "sep": "SEP", "sept": "SEP", "september": "SEP",
    "oct": "OCT", "october": "OCT", "nov": "NOV", "november": "NOV", "dec": "DEC", "december": "DEC",
}
MONTH_PATTERN = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"

# Patterns over the matching form.
PRODUCT_BAD = r"\b(not to be sold|do not|for details|visit|feedback|consumer|customer|marketed by|manufactured by|packed by|fssai|lic(?:ence|ense)?|manufacturing|packing date|use by|expiry|best before)\b"
PRODUCT_ADDRESS = r"\b(sector|phase|road|industrial area|sonipat|haryana|pincode|email|phone|tel|mobile)\b"
PRODUCT_NEIGHBOUR_BAD = r"\b(mrp|batch|net|packing|use by|expiry|consumer|customer|marketed|manufactured|fssai)\b"
QUANTITY_CONTEXT_BAD = r"\b(serving|calorie|calories|nutrition|protein|carbohydrate|sugar|sodium|fat|per serving|extra)\b"
BATCH_ADDRESS = r"\b(sector|phase|road|area|sonipat|haryana|email|fssai|customer|care|complaint)\b"
BATCH_NEIGHBOUR_BAD = r"\b(mrp|net|mfd|mfg|exp|use by|packing|quantity|weight|consumer|marketed|manufactured|fssai)\b"
COMPANY_BAD = r"\b(sector|phase|road|industrial area|sonipat|haryana|pincode|fssai|gst|license|lic no)\b"
COMPANY_NEIGHBOUR_BAD = r"\b(mrp|batch|net|quantity|weight|packing date|use by|expiry|consumer care|customer care|fssai|gst|email|phone|sector|phase|road|area|sonipat|haryana)\b"
COMPANY_SUFFIX = r"\b(international|foods?|food|industries|traders?|enterprise|enterprises|pvt|private|ltd|limited|co|company)\b"
BEST_BEFORE_NEIGHBOUR_BAD = r"\b(mrp|batch|net|packing|use by|expiry|consumer|customer|manufacturer|marketed|fssai)\b"
LICENCE_NEIGHBOUR_BAD = r"\b(phone|mobile|customer|consumer|email|gst|mrp|batch|quantity|weight|pincode)\b"
LICENCE_CONTEXT = r"\b(fssai|fssal|fsai|lic|license|licence)\b"
NEXT_DECLARATION = r"\b(mrp|batch|lot|net|weight|quantity|packing|use by|expiry|best before|consumer|customer|manufacturer|marketed|fssai|licence|license|email|phone|country of origin)\b"
ADDRESS_HINT = r"\b(sector|phase|road|street|area|industrial|estate|nagar|plot|block|district|dist\.?|lane|floor|sonipat|haryana|delhi|gurgaon|gurugram|noida|pin|pincode|\d{6})\b"
ADDRESS_PREFIX = r"^(?:f[-\s]?\d+|plot|house|h\.?no\.?|no\.?)\b"
ADDRESS_MARKERS = r"\b(sector|phase|road|street|area|industrial|estate|nagar|plot|block|district|sonipat|haryana|pin|pincode)\b"
ADDRESS_ANCHOR = r"(?i)\b(packed\s*&?\s*marketed\s*by|acked\s*&?\s*marketed\s*by|packed\s+by|marketed\s+by|manufactured\s+by|manufactured\s*&?\s*marketed\s+by|manufactured\s+and\s+marketed\s+by)\b"
ADDRESS_STOP = r"\b(mrp|batch|lot|net|quantity|weight|packing date|use by|expiry|best before|consumer care|customer care|fssai|license|licence|email|phone)\b"
ADDRESS_STOP_AFTER_ANCHOR = r"\b(mrp|batch|lot|net|quantity|weight|packing date|use by|expiry|best before|consumer care|customer care|fssai|license|licence|email|phone|feedback|complaints)\b"
# Words in contact names that are no company, and those that end company names.
CONTACT_STOP_WORDS = ["care", "customer", "customers", "support", "service", "services", "feedback", "contact", "info", "mail", "official", "admin", "help", "complaint", "complaints"]
COMPANY_SUFFIXES = ["international", "foods", "food", "industries", "industry", "traders", "trader", "enterprise", "enterprises", "company", "co", "ltd", "limited", "pvt", "private"]

PHONE = r"(?:(?:\+?\s*91)[\s\-()]*)?[6-9](?:[\s\-()]*\d){9}"
EMAIL = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"

# Fields of fusion, in order, and those compared strictly.
FIELDS = [
    "product_name", "ingredients", "nutrition", "veg_nonveg", "fssai_license_number", "mrp", "net_quantity", "batch_number", "manufacturing_date",
    "expiry_date", "best_before", "manufacturer", "manufacturer_address", "consumer_care", "country_of_origin", "allergen_declaration",
    "storage_instructions", "directions_for_use",
]
STRICT_FIELDS = ["mrp", "net_quantity", "batch_number", "fssai_license_number", "consumer_care"]
DECLARED_FIELDS = FIELDS[:15]

# The ten summary fields and their titles.
SUMMARY_FIELDS = {
    "product_name": "Product Name", "mrp": "MRP", "net_quantity": "Net Quantity", "manufacturer": "Manufacturer", "manufacturing_date": "Manufacturing Date",
    "expiry_date": "Expiry Date", "best_before": "Best Before", "consumer_care": "Consumer Care", "country_of_origin": "Country of Origin", "batch_number": "Batch Number",
}
# Other names of fields.
ALIASES = {"generic_name": "product_name", "fssai_license": "fssai_license_number", "licence_number": "fssai_license_number", "license_number": "fssai_license_number"}

# Marks of context in the text.
IMPORT_MARKS = ["imported", "country of origin", "made in", "packed in"]
FOOD_MARKS = ["ingredient", "ingredients", "fssai", "nutrition", "net weight", "food", "dal", "rice", "flour", "masoor", "pulse", "spice"]

"""Label dictionaries and value patterns (fixed values), in a spelling that Java and RE2 share but for word bounds."""

import re

#: Field: (pattern, strength), matched in any letter case.
LABELS = {
    "netQty": [(r"net\s*wt\.?", 0.9), (r"net\s*weight", 1.0), (r"net\s*qty\.?", 1.0), (r"net\s*quantity", 1.0), (r"net\s*contents?", 0.8)],
    "mrp": [(r"maximum\s*retail\s*price", 1.0), (r"\bmrp\b", 1.0), (r"m\s*\.\s*r\s*\.\s*p\s*\.?", 0.9)],
    "batch": [(r"batch\s*no\.?", 1.0), (r"batch\s*number", 1.0), (r"\bbatch\b", 0.8), (r"lot\s*no\.?", 0.9), (r"\blot\b", 0.6), (r"\bb\.?\s*no\.?", 0.7), (r"\bcode\b", 0.5)],
    "mfg": [(r"date\s*of\s*mfg\.?", 1.0), (r"date\s*of\s*manufacture", 1.0), (r"mfg\.?\s*date", 1.0), (r"mfd\.?\s*(date|on)?", 0.9), (r"manufactured\s*(on|date)?", 0.8), (r"pkd\.?\s*(date|on)?", 0.8), (r"packed\s*(on|date)?", 0.7), (r"\bmfg\b", 0.8), (r"\bmfd\b", 0.8)],
    "exp": [(r"use\s*by", 1.0), (r"best\s*before", 1.0), (r"date\s*of\s*expiry", 1.0), (r"\bexp\b\.?\s*(date|dt)?", 0.9), (r"expir(y|es|ation)", 0.9)],
    "manufacturer": [(r"brand\s*owned\s*(&|and)\s*marketed\s*by", 1.0), (r"manufactured\s*(&|and)\s*marketed\s*by", 1.0), (r"manufactured\s*by", 1.0), (r"marketed\s*by", 1.0), (r"mktd?\s*\.?\s*by", 0.8), (r"mfd\s*\.?\s*by", 0.8), (r"packed\s*by", 0.9), (r"pkd\s*\.?\s*by", 0.8), (r"imported\s*by", 1.0)],
    "care": [(r"consumer\s*care", 1.0), (r"customer\s*care", 1.0), (r"for\s*any\s*complaint", 0.9), (r"helpline", 0.9), (r"toll\s*free", 0.9), (r"contact\s*(manager\s*)?consumer", 0.8)],
    "fssai": [(r"fssai", 1.0), (r"lic\.?\s*no\.?", 0.7), (r"license\s*no\.?", 0.7), (r"licence\s*no\.?", 0.7)],
    "origin": [(r"country\s*of\s*origin", 1.0), (r"made\s*in", 0.9), (r"product\s*of", 0.8)],
}
#: Classifier classes that vote for a field.
CLASSES = {"netQty": "net_qty", "mrp": "mrp", "batch": "batch", "mfg": "mfg_date", "exp": "exp_date", "manufacturer": "manufacturer", "care": "care", "fssai": "fssai", "origin": "origin"}
#: Votes that count, and that begin a block of text.
VOTE_THRESHOLD, BLOCK_VOTE = 0.45, 0.6
SERVING = r"serving|per 100|rda|/serve|nutrition"
QUANTITY = r"(\d+(?:[.,]\d+)?)\s*(mg|g\b|gms?|grams?|kilograms?|kgs?|ml|cl|dl|litres?|liters?|l\b|pcs|pieces?|tablets?|capsules?)\b"
PRICE = r"(₹|Rs\.?|INR)?\s*(\d[\d,]*)(?:\.(\d{1,2}))?"
CURRENCY = r"₹|Rs\.?|INR"
PER_UNIT = r"\([^)]*(/|per)[^)]*\)"
BATCH = r"\b([A-Z0-9][A-Z0-9\-/]{2,23})\b"
BATCH_STOP = ["batch", "number", "no", "lot", "code", "mfg", "mrp", "india", "pack"]
DATE_NUMBER = r"\b(0?[1-9]|[12][0-9]|3[01])\s*[./\-]\s*(0?[1-9]|1[0-2])\s*[./\-]\s*(\d{2}|\d{4})\b"
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DATE_WORD = rf"\b({MONTHS})[\s,.\-]*(\d{{4}})\b"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
LANDLINE = r"0\d{2,4}[\s\-.]{0,2}\d{6,8}"
TOLL_FREE = r"(?:1800|1860)[\s\-]?\d{3,4}[\s\-]?\d{3,4}|1800\d{6}"
MOBILE = r"[6-9]\d{9}"
NEXT_LABEL = r"^[A-Z][A-Z .&()/\-]{4,}:"
NOT_A_NAME = r"trade\s*mark|registered|©|®.*(ltd|inc|pvt)|ingredients?|nutrition|manufactured|marketed|packed|imported|consumer|care|fssai|lic\.?\s*no|mrp|batch|mfg|exp|use\s*by|best\s*before|country\s*of\s*origin|made\s*in"
IDENTITY_VETO = ["ingredients", "nutrition", "manufacturer", "care", "barcode", "slogan_other"]
_WORD = "[A-Za-z0-9_]"
#: What every match of DATE_NUMBER, DATE_WORD and QUANTITY has in it: quick to look for.
DATE_NUMBER_HAS, DATE_WORD_HAS, QUANTITY_HAS = r"[0-9]\s*[./\-]\s*[0-9]", r"[0-9]{4}", r"[0-9]"


def stem(pattern: str) -> str:
    """Letters that any match of a label's pattern begins with, in lower case; '' where it may begin with others."""
    return re.match(r"(?:\\b)?((?:[a-z](?![?*{]))*)", pattern).group(1)


def java(pattern: str, any_case: bool = True) -> str:
    """The pattern for Java: word bounds count ASCII letters, digits and '_' only."""
    bound = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
    return ("(?i)" if any_case else "") + pattern.replace(r"\b", bound)


def alone(pattern: str) -> str:
    """The pattern with no digit on either side."""
    return rf"(?<!\d)(?:{pattern})(?!\d)"

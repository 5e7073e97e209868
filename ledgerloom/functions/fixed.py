"""Labels, patterns, dictionaries and constants that results depend on. The order counts where the first match wins.

Patterns are used with (?U), so that \\d, \\w, \\s and \\b mean what they mean in Unicode.
"""

# Fixed values. Labels: field, pattern on the lower-case line without accents, priority.
LABEL_PATTERNS = [
    ("total", r"total\s*(amount|a\s*payer|du|paid|due)?", 10),
    ("total", r"montant\s*(total|du|a\s*payer|dû)", 10),
    ("total", r"amount\s*(due|paid|charged|total)", 10),
    ("total", r"balance\s*(due|forward|totale?)?", 8),
    ("total", r"solde\s*(du|total|a\s*payer)?", 8),
    ("total", r"grand\s*total", 12),
    ("total", r"total\s*(current\s*charges?|charges?\s*including\s*tax)", 9),
    ("total", r"total\s*taxes?\s*(on|including)", 2),
    ("pre_tax", r"sub\s*total", 8),
    ("pre_tax", r"sous[\s-]total", 8),
    ("pre_tax", r"before\s*tax", 8),
    ("pre_tax", r"net\s*(amount|total)?", 6),
    ("pre_tax", r"netto", 6),
    ("pre_tax", r"monthly\s*charges?", 4),
    ("gst", r"(gst|tps)\s*(included|in\s*this\s*bill|on\s*charges?)?", 10),
    ("gst", r"(gst|tps)\s*@?\s*5\s*%?", 10),
    ("gst", r"federal\s*tax", 6),
    ("qst", r"(qst|tvq)\s*(included|in\s*this\s*bill|telecom)?", 10),
    ("qst", r"(qst|tvq)\s*@?\s*9[.,]?975?\s*%?", 10),
    ("qst", r"provincial\s*tax", 6),
    ("pst", r"pst\s*(@|tax)?", 8),
    ("pst", r"rst\s*(@|tax)?", 6),
    ("hst", r"hst\s*(tax|@)?", 8),
]

# Fixed values. An amount anywhere in a line, and a bare one at its end.
AMOUNT = r"(?:^|[\s:=\t])-?\$?(\d{1,6}[.,]\d{2})(?:\s*(?:CAD|USD|$))?"
AMOUNT_AT_END = r"(\d{1,6}[.,]\d{2})\s*$"

# Fixed values. Labels of a date.
DATE_CONFIRM = (
    r"(^bill\s*date|^invoice\s*date|^date\s*de\s*facturation|^transaction|^purchased|^date\s*d'achat|"
    r"^date\b(?!\s*d'expir|\s*limite|\s*de\s*retour))"
)
DATE_REJECT = r"(next|expir|valid\s*until|return|best\s*before|due\s*date|prochaine|renouvellement|void\s*after|print)"

# Fixed values. Names of months for the first parser.
FRENCH_MONTHS = {
    "janvier": 1, "fevrier": 2, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7,
    "aout": 8, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12, "décembre": 12,
    "janv": 1, "févr": 2, "fevr": 2, "juil": 7, "sept": 9,
}
ENGLISH_MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
# Fixed values. Names of months for the post-processor, in its own order.
LATE_MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "janvier": 1, "fevrier": 2, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7,
    "aout": 8, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12, "décembre": 12,
    "janv": 1, "févr": 2, "fevr": 2, "avr": 4, "juil": 7, "sept": 9,
}

# Fixed values. The post-processor's own labels and date patterns.
LATE_DATE_REJECT = (
    r"(expir|valid until|return by|retour avant|best before|meilleur avant|relev[eé]|print date|imprim|[eé]ch[eé]ance(?!.*fact)|"
    r"policy|politique|void after|annul|next bill|next billing|prochaine|next due|next payment|prochain paiement|renewal|renouvellement)"
)
LATE_DATE_PREFER = (
    r"(\bbill date\b|billing date|date de facturation|invoice date|statement date|\btransaction\b|purchase date|achat|\bdate\b|sale date|"
    r"\breceipt\b|re[cç]u le|processed on|paid on|pay[eé] le)"
)
LATE_DATE_PATTERNS = [
    r"\b(\d{4}-\d{2}-\d{2})\b",
    r"\b(\d{1,2}/\d{1,2}/\d{4})\b",
    r"\b(\d{1,2}-\d{1,2}-\d{4})\b",
    r"\b(\d{1,2}\.\d{1,2}\.\d{4})\b",
    r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\.?\s+\d{1,2},?\s*\d{4})\b",
    r"\b(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\.?\s*,?\s*\d{4})\b",
    r"\b(\d{1,2}\s+(?:janv?|f[eé]vr?|mars|avr|avril|mai|juin|juil|ao[uû]t|sept?|oct|nov|d[eé]c)\w*\.?\s*,?\s*\d{4})\b",
]

# Fixed values. Vendors by a keyword in the first lines.
KNOWN_VENDORS = {
    "home depot": "Home Depot", "rona": "Rona", "canadian tire": "Canadian Tire", "home hardware": "Home Hardware",
    "lowes": "Lowes", "lowe's": "Lowes",
    "iga": "IGA", "metro": "Metro", "maxi": "Maxi", "super c": "Super C", "loblaws": "Loblaws", "provigo": "Provigo",
    "walmart": "Walmart", "costco": "Costco", "dollarama": "Dollarama", "giant tiger": "Giant Tiger",
    "pharmaprix": "Pharmaprix", "shoppers": "Shoppers Drug Mart", "jean coutu": "Jean Coutu", "uniprix": "Uniprix", "brunet": "Brunet",
    "tim hortons": "Tim Hortons", "starbucks": "Starbucks", "mcdonald": "McDonald's", "subway": "Subway", "a&w": "A&W",
    "burger king": "Burger King", "pizza hut": "Pizza Hut", "domino": "Domino's", "bk": "Burger King",
    "virgin plus": "Virgin Plus", "virgin mobile": "Virgin Plus", "bell": "Bell", "rogers": "Rogers", "telus": "Telus",
    "videotron": "Videotron", "vidéotron": "Videotron", "fido": "Fido", "koodo": "Koodo", "fizz": "Fizz",
    "ups": "UPS", "united parcel service": "UPS", "fedex": "FedEx", "federal express": "FedEx", "dhl": "DHL",
    "canada post": "Canada Post", "postes canada": "Canada Post", "purolator": "Purolator",
    "hydro-québec": "Hydro-Quebec", "hydro-quebec": "Hydro-Quebec", "hydro québec": "Hydro-Quebec", "enbridge": "Enbridge",
    "gaz metro": "Energir", "energir": "Energir",
    "saq": "SAQ", "ikea": "IKEA", "best buy": "Best Buy", "staples": "Staples", "winners": "Winners", "homesense": "HomeSense",
    "simons": "Simons", "reitmans": "Reitmans",
    "ville de montreal": "Ville de Montreal", "ville de québec": "Ville de Quebec", "gouvernement du québec": "Gouvernement du Quebec",
    "revenu québec": "Revenu Quebec", "cra": "Canada Revenue Agency", "service canada": "Service Canada",
    "amazon": "Amazon", "apple": "Apple", "google": "Google", "microsoft": "Microsoft", "adobe": "Adobe", "ebay": "eBay",
    "paypal": "PayPal", "etsy": "Etsy", "shopify": "Shopify",
}

# Fixed values. Vendors by a domain anywhere in the text.
DOMAIN_VENDORS = {
    "virginplus.ca": "Virgin Plus", "virginmobile.ca": "Virgin Plus", "bell.ca": "Bell", "bell.net": "Bell",
    "rogers.com": "Rogers", "fido.ca": "Fido", "telus.com": "Telus", "koodo.com": "Koodo",
    "videotron.com": "Videotron", "videotron.ca": "Videotron", "hydroquebec.com": "Hydro-Quebec",
    "amazon.ca": "Amazon", "amazon.com": "Amazon", "homedepot.ca": "Home Depot", "homedepot.com": "Home Depot",
    "canadiantire.ca": "Canadian Tire", "walmart.ca": "Walmart", "walmart.com": "Walmart", "costco.ca": "Costco", "costco.com": "Costco",
    "iga.net": "IGA", "metro.ca": "Metro", "pharmaprix.ca": "Pharmaprix", "shoppersdrugmart.ca": "Shoppers Drug Mart",
    "jeancoutu.com": "Jean Coutu", "saq.com": "SAQ", "ikea.com": "IKEA", "staples.ca": "Staples", "bestbuy.ca": "Best Buy",
    "rona.ca": "Rona", "lowes.ca": "Lowes", "ville.montreal.qc.ca": "Ville de Montreal", "montreal.ca": "Ville de Montreal",
    "revenuquebec.ca": "Revenu Quebec", "canada.ca": "Government of Canada",
    "ups.com": "UPS", "ups.ca": "UPS", "fedex.com": "FedEx", "fedex.ca": "FedEx", "dhl.com": "DHL", "dhl.ca": "DHL",
    "canadapost.ca": "Canada Post", "postescanada.ca": "Canada Post", "purolator.com": "Purolator",
    "ebay.ca": "eBay", "ebay.com": "eBay", "paypal.com": "PayPal", "paypal.ca": "PayPal", "etsy.com": "Etsy",
}

# Fixed values. The post-processor's own domains, tried longest first.
LATE_DOMAIN_VENDORS = {
    "virginplus.ca": "Virgin Plus", "virginmobile.ca": "Virgin Plus", "bell.ca": "Bell", "rogers.com": "Rogers", "fido.ca": "Fido",
    "telus.com": "TELUS", "koodo": "Koodo", "videotron.com": "Vidéotron", "hydroquebec.com": "Hydro-Québec", "hydro.qc.ca": "Hydro-Québec",
    "hydro.on.ca": "Hydro One", "enbridge.com": "Enbridge Gas", "amazon.ca": "Amazon", "amazon.com": "Amazon", "paypal.com": "PayPal",
    "homedepot.ca": "Home Depot", "canadiantire.ca": "Canadian Tire", "ikea.com": "IKEA", "costco.ca": "Costco", "walmart.ca": "Walmart",
    "bestbuy.ca": "Best Buy", "staples.ca": "Staples", "dollarama.com": "Dollarama", "rona.ca": "Rona", "lowes.ca": "Lowe's",
    "saq.com": "SAQ", "metro.ca": "Metro", "iga.net": "IGA", "maxi.ca": "Maxi", "provigo.ca": "Provigo", "jeancoutu.com": "Jean Coutu",
    "pharmaprix.ca": "Pharmaprix", "shoppersdrugmart.ca": "Shoppers Drug Mart", "timhortons.com": "Tim Hortons",
    "mcdonalds.com": "McDonald's", "subway.com": "Subway",
}

# Fixed values. Vendors by what a logo reader says.
LOGO_VENDORS = {
    "home depot": "Home Depot", "canadian tire": "Canadian Tire", "costco": "Costco", "walmart": "Walmart", "iga": "IGA", "metro": "Metro",
    "jean coutu": "Jean Coutu", "pharmaprix": "Pharmaprix", "shoppers drug mart": "Shoppers Drug Mart", "shoppers": "Shoppers Drug Mart",
    "saq": "SAQ", "tim hortons": "Tim Hortons", "mcdonalds": "McDonald's", "mcdonald's": "McDonald's", "subway": "Subway",
    "dollarama": "Dollarama", "ikea": "IKEA", "rona": "Rona", "best buy": "Best Buy", "staples": "Staples", "winners": "Winners",
    "homesense": "HomeSense", "loblaws": "Loblaws", "provigo": "Provigo", "super c": "Super C", "maxi": "Maxi", "amazon": "Amazon", "apple": "Apple",
    "virgin plus": "Virgin Plus", "virgin mobile": "Virgin Plus", "virgin": "Virgin Plus", "bell": "Bell", "rogers": "Rogers", "telus": "Telus",
    "videotron": "Videotron", "vidéotron": "Videotron", "fido": "Fido", "koodo": "Koodo", "fizz": "Fizz",
    "hydro-québec": "Hydro-Québec", "hydro-quebec": "Hydro-Québec", "hydro": "Hydro-Québec", "enbridge": "Enbridge",
}

# Fixed values. Signs of marketplaces, buyers' labels, and lines that are no vendor.
MARKETPLACES = [
    (r"ebay\.c|order\s+from\s+ebay|ebay\s+order|sold\s+on\s+ebay", "eBay"),
    (r"amazon\.c|fulfilled\s+by\s+amazon|sold\s+by.*amazon", "Amazon"),
    (r"paypal\.c|payment\s+via\s+paypal|paypal\s+receipt", "PayPal"),
    (r"etsy\.c|etsy\s+order|etsy\s+receipt", "Etsy"),
]
BUYER_LINE = (
    r"^(ship\s*to|bill\s*to|sold\s*to|deliver\s*to|buyer|customer|livrer\s*(a|à)|factur[eé]\s*(a|à)|acheteur|nom\s*du\s*client)\s*[:\-]?\s*$"
)
BUYER_INLINE = r"^(ship\s*to|bill\s*to|sold\s*to|deliver\s*to|buyer|customer|livrer|factur[eé]|acheteur)\s*[:\-]"
NOT_A_VENDOR = r"(receipt|reçu|facture|invoice|bill|date|tel:|www\.|http)"
PLACEHOLDER_VENDOR = r"^\s*(receipt|reçu|facture|tax invoice|\d+|unknown|n/?a|none)\s*$"

# Fixed values. Words of bank statements.
BANK_KEYWORDS = [
    "account summary", "account balance", "previous balance", "new balance", "credit limit", "available credit",
    "payment due date", "minimum payment", "annual fee", "transaction date", "posting date", "merchant name",
    "opening balance", "closing balance", "interest charged", "finance charge", "periodic rate", "annual percentage",
]

# Fixed values. Suffixes of companies, characters that look like digits.
LEGAL_SUFFIXES = ["inc", "ltd", "corp", "co", "llc"]
OCR_LOOKALIKES = ("OolISBGZ§", "001158625")

# Fixed values. Penalties by the start of a warning; the first that fits counts.
PENALTIES = [
    ("DATE_MISSING", 0.15),
    ("DATE_PARSE_FAILED", 0.10),
    ("MATH_MISMATCH", 0.20),
    ("MATH_MISSING_TOTAL", 0.25),
    ("OCR_UNPARSEABLE", 0.15),
    ("TAX_SANITY", 0.10),
]
# Fixed values. Thresholds and names.
MATH_TOLERANCE = 0.15
MATH_ADJUSTABLE = 2.0
MAX_TAX_RATIO = 0.50
REVIEW_CONFIDENCE = 0.65
MIN_TEXT_CHARS = 40
LARGE_TEXT_CHARS = 15_000
LARGE_TEXT_HEAD, LARGE_TEXT_TAIL = 8_000, 2_000
BOTTOM_MARK = "\n\n[BOTTOM REGION RESCAN]\n"
LARGE_TEXT_GAP = "\n\n[... middle section omitted ...]\n\n"
STATEMENT_CHARS = 200_000
STATEMENT_KEYWORDS = 3
OCR_ROW_GAP = 15.0
RECEIPT_TAG = "receipt-processed"
DEFAULT_SETTINGS = {"use_stored_text_first": "true", "skip_vision_if_text_exists": "true", "force_rescan": "false"}
TAXES = ("gst", "qst", "pst", "hst")

"""Word tables and code tables of the normalisers. Results depend on each of them."""

# Legal forms and stop words that a core name leaves out.
LEGAL_WORDS = (
    "inc incorporated llc corp corporation co company cos ltd limited lp llp plc pc pllc pa the of and an a dba "
    "pvt private pvtltd ms opc huf "
    "sarl sas sasu sa eurl sci snc selarl scp scm sca gie sel et de du des la le les au aux en gmbh ag bv nv spa srl "
    "india france usa"
).split()
# Further ones for France.
LEGAL_WORDS_FR = ["cie", "compagnie", "ei"]

# States of the United States.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
    "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc", "puerto rico": "pr",
}
# States of India, then spellings of them that transliteration yields.
IN_STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl",
    "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn",
    "telangana": "tg", "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk", "uttaranchal": "uk", "west bengal": "wb", "delhi": "dl", "jammu and kashmir": "jk", "chandigarh": "ch", "puducherry": "py", "pondicherry": "py",
    "ladakh": "la", "dadra and nagar haveli": "dn", "daman and diu": "dd", "lakshadweep": "ld", "andaman and nicobar islands": "an",
    "madhy pradesh": "mp", "maharashtr": "mh", "gujrat": "gj", "pashchim bang": "wb", "pashchimabang": "wb", "tamilnadu": "tn", "karnatak": "ka", "telangan": "tg", "panjab": "pb", "tamizhnatu": "tn", "tamilnatu": "tn",
    "tamizhnadu": "tn", "andhr pradesh": "ap", "dilli": "dl", "pashchim bangal": "wb", "paschim bangal": "wb", "keral": "kl", "asam": "as", "hariyana": "hr", "jharakhand": "jh", "chhattisagadh": "cg", "chhattisagarh": "cg",
    "orisa": "od", "gov": "ga",
}
# Address words and their short forms.
ADDRESS_WORDS = {
    "street": "st", "str": "st", "saint": "st", "road": "rd", "avenue": "ave", "av": "ave", "avenu": "ave", "drive": "dr", "lane": "ln", "boulevard": "blvd", "bd": "blvd", "bld": "blvd", "court": "ct", "place": "pl",
    "circle": "cir", "highway": "hwy", "parkway": "pkwy", "terrace": "ter", "trail": "trl", "square": "sq", "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se",
    "southwest": "sw", "apartment": "apt", "suite": "ste", "floor": "fl", "flr": "fl", "building": "bldg", "near": "nr", "opposite": "opp", "sector": "sec", "cross": "crs", "mount": "mt", "fort": "ft", "point": "pt",
    "heights": "hts", "junction": "jn", "r": "rue", "chemin": "ch", "allee": "all", "impasse": "imp", "route": "rte", "quai": "qu", "residence": "res", "nagar": "ngr", "colony": "col", "township": "twp",
}
# Address words that carry nothing.
ADDRESS_FILLER = "null na n a unit apt no number door h d hno dno ste fl c o co the of de du des la le les l and et".split()
# French address words.
ADDRESS_WORDS_FR = {"bis": "b", "ter": "t", "quater": "q", "crs": "cours", "rpt": "rondpoint", "rdpt": "rondpoint", "appartement": "apt", "appt": "apt", "app": "apt"}

# Regions of France, each with its code, then the departments of each.
_FR_REGIONS = {
    "auvergne rhone alpes": "ara", "bourgogne franche comte": "bfc", "bretagne": "bre", "centre val de loire": "cvl", "centre": "cvl", "corse": "cor", "grand est": "ges", "hauts de france": "hdf", "ile de france": "idf", "normandie": "nor",
    "nouvelle aquitaine": "naq", "occitanie": "occ", "pays de la loire": "pdl", "provence alpes cote d azur": "pac", "provence alpes cote dazur": "pac", "paca": "pac", "guadeloupe": "gua", "martinique": "mtq", "guyane": "guf",
    "la reunion": "reu", "reunion": "reu", "mayotte": "myt",
}
_FR_DEPARTMENTS = {
    "ara": "ain, allier, ardeche, cantal, drome, isere, loire, haute loire, puy de dome, rhone, savoie, haute savoie",
    "bfc": "cote d or, cote dor, doubs, jura, nievre, haute saone, saone et loire, yonne, territoire de belfort",
    "bre": "cotes d armor, cotes darmor, finistere, ille et vilaine, morbihan",
    "cvl": "cher, eure et loir, indre, indre et loire, loir et cher, loiret",
    "cor": "corse du sud, haute corse",
    "ges": "ardennes, aube, marne, haute marne, meurthe et moselle, meuse, moselle, bas rhin, haut rhin, vosges",
    "hdf": "aisne, nord, oise, pas de calais, somme",
    "idf": "paris, seine et marne, yvelines, essonne, hauts de seine, seine saint denis, val de marne, val d oise, val doise",
    "nor": "calvados, eure, manche, orne, seine maritime",
    "naq": "charente, charente maritime, correze, creuse, dordogne, gironde, landes, lot et garonne, pyrenees atlantiques, deux sevres, vienne, haute vienne",
    "occ": "ariege, aude, aveyron, gard, haute garonne, gers, herault, lot, lozere, hautes pyrenees, pyrenees orientales, tarn, tarn et garonne",
    "pdl": "loire atlantique, maine et loire, mayenne, sarthe, vendee",
    "pac": "alpes de haute provence, hautes alpes, alpes maritimes, bouches du rhone, var, vaucluse",
}
FR_AREAS = {k: f"frreg{v}" for k, v in _FR_REGIONS.items()} | {k: f"frreg{v}" for v, names in _FR_DEPARTMENTS.items() for k in names.split(", ")}

# Digits that stand for letters.
LEET_FROM, LEET_TO = "0123456789", "olzeasgtbg"

# Letters without a canonical decomposition, and apostrophes.
FOLDED = {"ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "’": "'", "‘": "'", "`": "'", "´": "'", "°": " ", "º": " "}

# Letters of the nine ISCII-ordered Indic blocks by their place in the block of 128.
INDIC_CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n", 0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh",
    0x28: "n", 0x29: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l", 0x34: "zh", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h",
    0x58: "q", 0x59: "kh", 0x5A: "g", 0x5B: "z", 0x5C: "r", 0x5D: "rh", 0x5E: "f", 0x5F: "y",
}
INDIC_VOWELS = {0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0C: "l", 0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x50: "om", 0x60: "ri", 0x61: "l"}
INDIC_SIGNS = {0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x44: "ri", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x62: "l", 0x63: "l"}
INDIC_NASALS = {0x01: "n", 0x02: "n", 0x03: "h", 0x70: "n"}
MALAYALAM_CHILLU = {0x7A: "n", 0x7B: "n", 0x7C: "r", 0x7D: "l", 0x7E: "l", 0x7F: "k"}

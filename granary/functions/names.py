"""Fixed spelling tables of markets, varieties, districts and seasons.

All of them are fixed values with at most about a hundred entries, so joining
them as small broadcast tables is bounded.
"""

from __future__ import annotations

CANONICAL_MARKETS = {
    "rice": (
        "Kalna", "Bishnupur(Bankura)", "Burdwan", "Alipurduar", "Jalpaiguri Sadar", "Egra/contai", "Samsi",
        "Kalyani", "Tamluk (Medinipur E)", "Champadanga", "Jhargram", "Memari", "Bolpur", "Barasat",
        "English Bazar", "Diamond Harbour(South 24-pgs)", "Baruipur(Canning)", "Balarampur", "Ghatal",
        "Rampurhat", "Katwa", "Suri", "Habra", "Basirhat", "Medinipur", "Coochbehar", "Siliguri", "Malda",
        "Kolaghat"),
    "wheat": (
        "Bishnupur(Bankura)", "Durgapur", "Bolpur", "Khatra", "Kaliaganj", "Bankura Sadar", "Asansol",
        "Birbhum", "Samsi", "Sainthia", "Kalna", "Burdwan", "Malda", "Siliguri", "English Bazar",
        "Rampurhat", "Kolaghat", "Khanna"),
    "potato": (
        "Champadanga", "Jalpaiguri Sadar", "Alipurduar", "Burdwan", "Pandua", "Sheoraphuly",
        "Bishnupur(Bankura)", "Dhupguri", "Purulia", "Coochbehar", "Kalna", "Memari", "Katwa", "Ghatal",
        "Egra/contai", "Kolaghat", "Agra"),
    "tea": (
        "Kolkata", "Siliguri", "Jalpaiguri Sadar", "Coochbehar", "Alipurduar", "Naharlagun",
        "Adilabad(Rythu Bazar)", "Sakhigopal"),
}

MARKET_ALIASES = {
    "bardhaman": "Burdwan",
    "diamond harbour": "Diamond Harbour(South 24-pgs)",
    "baruipur": "Baruipur(Canning)",
    "canning": "Baruipur(Canning)",
    "bishnupur": "Bishnupur(Bankura)",
    "jalpaiguri": "Jalpaiguri Sadar",
    "tamluk": "Tamluk (Medinipur E)",
    "egra": "Egra/contai",
    "contai": "Egra/contai",
    "sheoraphuli": "Sheoraphuly",
}

CANONICAL_VARIETIES = {
    "rice": (
        "Common", "Fine", "Super Fine", "Other", "Ratnachudi (718 5-749)", "Sona Mansoori Non Basmati",
        "Masuri", "Coarse", "H.Y.V.", "Sona"),
    "wheat": (
        "Other", "Sonalika", "Kalyan", "Sona", "Local", "White", "PBW-343", "Medium", "Bansi", "Deshi", "Dara"),
    "potato": (
        "Jyoti", "Other", "Local", "Red", "Desi", "F.A.Q.", "Chandermukhi", "(Red Nanital)", "Potato",
        "Kufri Giriraj"),
    "tea": ("Other", "All Dust", "Cachar C.T.C. Leaf", "CTC", "Leaf", "Dust"),
}

VARIETY_ALIASES = {
    "paddy (dhan) (common)": "Common",
    "paddy(dhan)(common)": "Common",
    "rice (common)": "Common",
    "dhan(common)": "Common",
    "paddy (dhan) (fine)": "Fine",
    "superfine": "Super Fine",
    "swarna": "Other",
    "minikit": "Other",
    "potato (jyoti)": "Jyoti",
    "chandramukhi": "Chandermukhi",
    "pbw343": "PBW-343",
}

DISTRICTS = (
    "Alipurduar", "Bankura", "Bardhaman", "Birbhum", "Cooch Behar", "Dakshin Dinajpur", "Darjeeling",
    "Hooghly", "Howrah", "Jalpaiguri", "Jhargram", "Kalimpong", "Maldah", "Murshidabad", "Nadia",
    "North 24 Parganas", "Paschim Bardhaman", "Paschim Medinipur", "Purba Bardhaman", "Purba Medinipur",
    "Purulia", "South 24 Parganas", "Uttar Dinajpur")

# Spellings after lower-casing and turning "-" into a blank; canonical names match by themselves.
DISTRICT_ALIASES = {
    "24 paraganas north": "North 24 Parganas",
    "24 parganas north": "North 24 Parganas",
    "north 24 pargana": "North 24 Parganas",
    "north 24 paraganas": "North 24 Parganas",
    "24 paraganas south": "South 24 Parganas",
    "24 parganas south": "South 24 Parganas",
    "south 24 pargana": "South 24 Parganas",
    "south 24 paraganas": "South 24 Parganas",
    "dinajpur dakshin": "Dakshin Dinajpur",
    "south dinajpur": "Dakshin Dinajpur",
    "dinajpur uttar": "Uttar Dinajpur",
    "north dinajpur": "Uttar Dinajpur",
    "coochbehar": "Cooch Behar",
    "koch bihar": "Cooch Behar",
    "medinipur west": "Paschim Medinipur",
    "west midnapore": "Paschim Medinipur",
    "midnapore west": "Paschim Medinipur",
    "paschim midnapore": "Paschim Medinipur",
    "medinipur east": "Purba Medinipur",
    "east midnapore": "Purba Medinipur",
    "midnapore east": "Purba Medinipur",
    "purba midnapore": "Purba Medinipur",
    "alipur duar": "Alipurduar",
    "burdwan": "Bardhaman",
    "west bardhaman": "Paschim Bardhaman",
    "bardhaman west": "Paschim Bardhaman",
    "west burdwan": "Paschim Bardhaman",
    "burdwan west": "Paschim Bardhaman",
    "east bardhaman": "Purba Bardhaman",
    "bardhaman east": "Purba Bardhaman",
    "east burdwan": "Purba Bardhaman",
    "burdwan east": "Purba Bardhaman",
    "hugli": "Hooghly",
    "haora": "Howrah",
    "malda": "Maldah",
}

UNKNOWN_TEXT = ("", "none", "nan", "null", "unknown", "?")

SEASON_ALIASES = {
    "autumn": "Autumn",
    "aus": "Autumn",
    "pre-kharif": "Autumn",
    "winter": "Winter",
    "aman": "Winter",
    "kharif": "Winter",
    "summer": "Summer",
    "boro": "Summer",
    "rabi": "Summer",
}

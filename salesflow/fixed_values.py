"""Labels, spelling maps, edges and keywords that define the results.

They are stated as plain text in their natural order and are used by every other module.
"""

MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

AGE_GROUPS = ["18-25", "26-35", "36-45", "46-55", "55+"]

LOYALTY_TIERS = ["New", "Occasional", "Regular", "Loyal"]
LOYALTY_EDGES = [0, 1, 3, 7, None]  # None: no upper end

PRICE_BANDS = ["<₹500", "₹500–₹1k", "₹1k–₹5k", "₹5k–₹10k", "₹10k–₹50k", ">₹50k"]
PRICE_BAND_EDGES = [0, 500, 1000, 5000, 10000, 50000, None]

PRICE_TIERS = ["Very Low", "Low", "Mid", "High", "Premium"]
PRICE_TIER_EDGES = [0, 500, 1000, 5000, 10000, None]  # used when the quantile edges coincide

CITY_SPELLINGS = {
    "Bengalore": "Bangalore",
    "Banglore": "Bangalore",
    "Bengaluru": "Bangalore",
    "Delhi Ncr": "Delhi",
    "New Delhi": "Delhi",
    "Del": "Delhi",
    "Calcutta": "Kolkata",
    "Kolkatta": "Kolkata",
    "Kolkat": "Kolkata",
    "Bombay": "Mumbai",
    "Mumba": "Mumbai",
    "Chenai": "Chennai",
    "Madras": "Chennai",
    "Chenni": "Chennai",
    "Chennaii": "Chennai",
}

CATEGORY_SPELLINGS = {
    "Electronics": "Electronics & Accessories",
    "Electronicss": "Electronics & Accessories",
    "Electronic": "Electronics & Accessories",
}

STATE_NAMES = {
    "Andaman and Nicobar": "Andaman & Nicobar Islands",
    "Delhi": "NCT of Delhi",
    "Jammu & Kashmir": "Jammu and Kashmir",
    "Odisha": "Orissa",
    "Telangana": "Telangana",
    "Pondicherry": "Puducherry",
    "Uttaranchal": "Uttarakhand",
    "Dadra and Nagar Haveli": "Dadra & Nagar Haveli and Daman & Diu",
    "Chhattisgarh": "Chhattisgarh",
}

# Tested in this order, by lower-case substring; the short "id" also hits "Friday" and "Holiday".
FESTIVAL_KEYWORDS = {
    "Diwali": ["diwali", "deepavali"],
    "Prime Day": ["prime"],
    "Holi": ["holi"],
    "Dussehra": ["dussehra", "vijayadashami"],
    "Independence Day": ["independence"],
    "New Year": ["new year"],
    "Eid": ["eid", "id"],
}
NO_FESTIVAL_KEY = "Non-Festival"
NO_FESTIVAL_NAME = "No Festival"

TRUE_WORDS = ["true", "1", "yes"]
FALSE_WORDS = ["false", "0", "no"]
RETURNED_WORDS = ["yes", "true", "returned", "1"]

DELIVERY_WORDS = {"Same Day": "0", "same day": "0", "Express": "1", "express": "1", "15": "1.5"}
MAX_DELIVERY_DAYS = 30
ON_TIME_DAYS = 3
MAX_RATING = 5

PRICE_COLUMNS = ["original_price_inr", "discounted_price_inr", "subtotal_inr", "final_amount_inr"]
CAPPED_COLUMNS = ["original_price_inr", "discounted_price_inr", "final_amount_inr"]
SCALE_ERROR_LIMIT = 10000
SCALE_ERROR_DIVISOR = 10

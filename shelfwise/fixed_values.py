# Fixed values. Results depend on these words, numbers, patterns and formats; they are defaults, and
# every operator takes its own as a parameter.

# --- text patterns -----------------------------------------------------------------------------
SEARCH_TOKEN_PATTERN = "[a-z0-9]+"
REVIEW_TOKEN_PATTERN = "[a-z']+"
SENTENCE_BREAK_PATTERN = "[.!?]+"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
IMAGE_PROMPT = "product photo of %s, a %s item, %s, white background, studio lighting"

# --- search and ranking ------------------------------------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
FUSION_ALPHA = 0.5
DEFAULT_LIMIT = 12
MAX_LIMIT = 50
FLAT_RANGE = 1e-9
CANDIDATE_POOL = 30
NEIGHBOUR_LIMIT = 4
NEIGHBOUR_POOL = 12
MAX_RATING_COUNT = 4200
SEARCH_WEIGHTS = {"rating": 0.05, "popularity": 0.05, "diversity": 0.15}
RECOMMENDATION_WEIGHTS = {"rating": 0.0, "popularity": 0.0, "diversity": 0.15}
EMBEDDING_DIGITS = 6

# --- fraud -------------------------------------------------------------------------------------
VELOCITY_MINUTES = 15
FRAUD_WEIGHTS = {"velocity": 0.55, "region_risk": 0.30, "new_account_high_value": 0.25}
FRAUD_THRESHOLD = 0.5
NEW_ACCOUNT_DAYS = 14
HIGH_VALUE_AMOUNT = 150.0
FRAUD_REPORT_ROWS = 200

# --- inventory ---------------------------------------------------------------------------------
HOLT_ALPHA = 0.3
HOLT_BETA = 0.1
HORIZON_DAYS = 14
LEAD_TIME_DAYS = 7
SERVICE_LEVEL_Z = 1.65
NO_DEMAND = 1e-6
INVENTORY_REPORT_ROWS = 200

# --- pricing -----------------------------------------------------------------------------------
CURVE_MULTIPLIERS = [0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3]
RAISE_PCT = 5.0
LOWER_PCT = -5.0
PRICE_LABELS = ["raise", "lower", "near-optimal"]

# --- reviews -----------------------------------------------------------------------------------
FAKE_WEIGHTS = {"duplicate_text": 0.4, "author_burst": 0.35, "generic_text": 0.25}
FAKE_THRESHOLD = 0.5
DUPLICATE_COPIES = 3
BURST_REVIEWS = 3
BURST_PRODUCTS = 3
BURST_DAYS = 7

POLARITY = {
    "excellent": 3.0, "amazing": 3.0, "fantastic": 3.0, "perfect": 3.0, "incredible": 3.0,
    "outstanding": 3.0, "love": 2.5, "loved": 2.5, "best": 2.5, "wonderful": 2.5,
    "impressive": 2.5, "flawless": 3.0, "exceeded": 2.0, "obsessed": 2.5, "premium": 2.0,
    "good": 1.5, "great": 2.0, "nice": 1.0, "solid": 1.5, "sturdy": 1.5, "durable": 1.5,
    "comfortable": 1.5, "reliable": 1.5, "easy": 1.0, "smooth": 1.0, "happy": 1.5,
    "satisfied": 1.5, "recommend": 1.5, "recommended": 1.5, "value": 1.0, "worth": 1.0,
    "quality": 1.0, "fast": 1.0, "convenient": 1.0, "clean": 1.0, "pleasant": 1.5,
    "subtle": 0.5, "engaging": 1.5, "beautiful": 2.0, "beautifully": 2.0, "sleek": 1.0,
    "intuitive": 1.5, "roomy": 1.0, "lightweight": 1.0, "effective": 1.5, "works": 1.0,
    "glad": 1.5, "pleased": 1.5, "consistently": 0.5, "instantly": 0.5, "rock": 0.5,
    "delighted": 2.0,
    "terrible": -3.0, "horrible": -3.0, "awful": -3.0, "worst": -3.0, "disgusting": -3.0,
    "broken": -2.5, "useless": -2.5, "garbage": -3.0, "junk": -2.5, "unacceptable": -2.5,
    "disappointing": -2.0, "disappointed": -2.0, "hazard": -2.5, "destroyed": -2.0,
    "bad": -1.5, "cheap": -1.0, "flimsy": -1.5, "poor": -1.5, "uncomfortable": -1.5,
    "unreliable": -1.5, "confusing": -1.0, "difficult": -1.0, "hard": -0.5, "slow": -1.0,
    "loose": -1.0, "greasy": -1.0, "sticky": -1.0, "overpriced": -1.5, "underwhelming": -1.5,
    "stale": -1.5, "artificial": -0.5, "questionable": -1.0, "impractical": -1.0,
    "fell": -1.0, "wore": -0.5, "drains": -1.0, "dropping": -1.0, "loses": -1.0,
    "lost": -0.5, "wish": -0.5, "unpleasant": -1.5, "overpowering": -1.0, "bulkier": -0.5,
    "bulky": -0.5, "smaller": -0.5, "shorter": -0.5, "padded": -0.5, "inconsistent": -1.0,
    "dry": -0.5, "hazardous": -2.0, "cracked": -1.5, "fiddly": -1.0,
}
NEGATIONS = ["not", "no", "never", "n't", "without", "hardly"]
INTENSIFIERS = {
    "very": 1.5, "extremely": 2.0, "incredibly": 2.0, "really": 1.3, "totally": 1.5,
    "surprisingly": 1.3, "absolutely": 1.8, "barely": 0.5,
}

ASPECT_KEYWORDS = {
    "Electronics": {
        "battery life": ["battery"],
        "build quality": ["sturdy", "flimsy", "well made", "cheap", "loose", "built"],
        "connectivity": ["connect", "connection", "pairing", "pair", "dropping"],
        "price": ["price", "value", "worth", "money", "overpriced", "cost"],
    },
    "Home & Kitchen": {
        "build quality": ["heavy-duty", "durable", "falling apart", "flimsy", "last"],
        "ease of use": ["easy to use", "setup", "instructions", "fiddly"],
        "size": ["size", "bulkier", "compact", "small", "roomy"],
        "price": ["price", "value", "worth", "cost", "overpriced", "penny"],
    },
    "Books": {
        "writing": ["writing", "written", "follow"],
        "print quality": ["print", "pages", "bound", "binding"],
        "length": ["length", "short", "long", "padded", "content"],
        "price": ["price", "worth", "overpriced", "cost"],
    },
    "Clothing": {
        "fit": ["fit", "fits", "size", "small"],
        "fabric quality": ["fabric", "material", "pilled"],
        "comfort": ["comfortable", "uncomfortable", "seams", "comfort"],
        "price": ["price", "worth", "overpriced", "cost", "penny"],
    },
    "Sports & Outdoors": {
        "durability": ["durable", "holds up", "wore out", "broke", "durability"],
        "comfort": ["comfortable", "uncomfortable", "comfort"],
        "weight": ["lightweight", "heavier", "weight", "carry"],
        "price": ["price", "worth", "overpriced", "investment", "money"],
    },
    "Beauty": {
        "scent": ["scent", "smell", "smells"],
        "texture": ["texture", "greasy", "sticky", "absorbs"],
        "effectiveness": ["works", "difference", "advertised", "effective"],
        "price": ["price", "worth", "overpriced", "penny", "cost"],
    },
    "Toys": {
        "durability": ["durable", "broke", "holding up", "survives", "rough play"],
        "fun factor": ["fun", "obsessed", "entertained", "interest"],
        "safety": ["safe", "safety", "hazard", "sharp", "small parts"],
        "price": ["price", "worth", "overpriced", "penny", "cost"],
    },
    "Grocery": {
        "taste": ["taste", "tastes", "tasted"],
        "freshness": ["fresh", "freshness", "stale"],
        "packaging": ["packaging", "package", "resealable", "damaged"],
        "price": ["price", "worth", "overpriced", "penny", "cost"],
    },
    "Office Supplies": {
        "build quality": ["sturdy", "flimsy", "cracked", "well made"],
        "ease of use": ["easy", "intuitive", "complicated", "instructions"],
        "design": ["design", "sleek", "looks", "impractical"],
        "price": ["price", "worth", "overpriced", "penny", "cost"],
    },
    "Pet Supplies": {
        "durability": ["holds up", "destroyed", "chewing", "intact", "durable"],
        "size": ["size", "sizing", "smaller", "bulky"],
        "ease of use": ["easy", "clean", "effortless", "hassle"],
        "price": ["price", "worth", "overpriced", "penny", "cost"],
    },
}

# --- photo matching ----------------------------------------------------------------------------
PHOTO_LICENSES = [
    "cc0", "cc-by", "cc-by-2.0", "cc-by-3.0", "cc-by-4.0", "cc-by-sa-2.0", "cc-by-sa-3.0",
    "cc-by-sa-4.0", "public domain", "pd",
]
PHOTO_EXTENSIONS = [".jpg", ".jpeg", ".png"]
PHOTO_STOPWORDS = ["set", "kit", "pack", "pouch", "the", "a", "an", "of", "for"]
HISTORICAL_PATTERNS = [
    r"\b(1[6-9]\d{2}|19[0-8]\d)\b",
    r"\b\d{1,2}(st|nd|rd|th)[\s-]century\b",
    "century",
]
NEGATIVE_KEYWORDS = [
    "painting", "attributed", "engraving", "illustration", "drawing", "sketch",
    "portrait", "sculpture", "statue", "manuscript", "postcard", "stamp", "coin",
    "vintage", "antique", "museum", "exhibition", "gallery", "woodcut", "etching",
    "military", "army", "navy", "marine", "war", "combat", "weapon", "grenade",
    "bomb", "soldier", "troops", "operation", "nara", "injury", "wound", "medic",
    "casualty", "gun", "rifle", "ammunition",
    "caption", "advertisement", "poster", "magazine", "newspaper",
    "ad", "coupon", "brochure", "catalog", "catalogue",
    "dall-e", "dall·e", "midjourney", "stable diffusion", "ai-generated",
    "ai generated", "generated by ai", "artstation", "generative ai",
    "flag", "logo", "diagram", "coat of arms", "map", "figure",
    "junya watanabe", "yale center for british art", "cryptomeria japonica",
    "mary mcleod bethune",
]
REJECTED_TITLES = [
    "File:Bike helmet lamps jeh.jpg",
    "File:Mercury render with Blender 01.png",
    "File:Hair dryer in a bag in the hotel bathroom.jpg",
    "File:Hair dryer in a bag in the hotel bathroom (with label legible).jpg",
    "File:Notebook writing.jpg",
    "File:19th century knowledge hiking and camping sheepskin knapsack sleeping bag.jpg",
    "File:Tiffany - Spice set in presentation box.jpg",
    "File:Storage containers in Svalbard Global Seed Vault 01.jpg",
    "File:The Sun Has Got His Hat On.jpg",
    "File:Hang Whiteboard On Door With Over The Door Hooks.png",
    "File:Movable Whiteboard Goes Around Table.png",
    "File:Jeno's Pizza Rolls air fryer ad.jpg",
    "File:Central Building for Block of Two Setts (Sets) of Barracks, Fort Hamilton, New York - DPLA - e1d856ebb299a51c4676e9000af32b58.jpg",
    "File:Coffee grinder 2.jpg",
    "File:2002 Junya Watanabe for Comme des Garçons jacket, blue denim jeans patchwork 01.jpg",
    "File:Retro desk lamp.jpg",
    "File:FMIB 44367 Messrs Farlow's Patent Reel and Rod Rest for Big Game Fishing.jpeg",
    "File:EFTA00001880 - Closed laptop rests on a black perforated stand labeled THEATER 2 in a professional audio setup.jpg",
    "File:Close-up of Plaid Pet Carrier Bag with Flower Charm.jpg",
    "File:DALL-E - Professional model photo of anthropomorphic rhinoceros wearing a business suit in a dark room, ring light shine on top of him.jpg",
    "File:Barbara Bodichon - Sketchbook - B1991.23.2(1) - Yale Center for British Art.jpg",
    "File:Cryptomeria japonica with trekking poles on Mount Horaiji.jpg",
    "File:Coffee grinder with coffee.jpg",
    "File:A Jungle Kitchen. Cooking in Bamboo Utensils.jpg",
    "File:Denim jacket with fox lining, Düsseldorf, November 2025.jpg",
    "File:Filing cabinet, office, Mary McLeod Bethune Council House NHS.jpg",
    "File:EFTA00000622 - Neatly organized home gym closet featuring exercise balls foam rollers and a resistance band system.jpg",
]
QUERY_OVERRIDES = {
    "Blender": "blender jug kitchen",
    "Sun Hat": "sun hat clothing",
    "Spice Set": "spice rack bottles kitchen",
    "Reference Manual": "instruction manual book cover",
    "Automatic Feeder": "pet automatic feeder bowl",
    "4K Monitor": "led monitor screen computer",
    "Card Game": "playing cards deck",
    "Kite": "kite toy sky",
    "Litter Mat": "cat litter mat",
    "Grooming Brush": "dog grooming brush",
    "Nail Care Kit": "manicure set nail clippers",
    "Foam Roller": "foam roller fitness equipment",
    "Sticky Note Pack": "post-it notes pad",
    "Adjustable Harness": "dog harness",
    "Illustrated Atlas": "world atlas book",
    "Puzzle Collection": "puzzle book",
    "Non-Stick Pan": "frying pan kitchen",
    "Ceramic Dinner Set": "ceramic dinner plate set",
    "Wireless Headphones": "over-ear wireless headphones",
    "USB-C Hub": "usb-c hub adapter",
    "Mechanical Keyboard": "mechanical keyboard computer",
    "Portable Charger": "portable power bank charger",
    "Noise-Cancelling Earbuds": "wireless earbuds case",
    "Laptop Stand": "laptop riser stand desk",
    "Chef Knife Set": "chef knife set kitchen",
    "Cast Iron Skillet": "cast iron skillet pan",
    "Air Fryer": "air fryer kitchen appliance",
    "Stand Mixer": "stand mixer kitchen appliance",
    "Storage Containers": "plastic storage containers kitchen",
    "Bamboo Utensil Set": "bamboo kitchen utensils",
    "Beginner's Guide": "how-to guide book",
    "Field Notebook": "pocket notebook journal",
    "Cookbook": "cookbook recipe book",
    "Short Story Anthology": "short stories book",
    "Poetry Collection": "poetry book",
    "Study Planner": "student planner notebook",
    "Running Jacket": "running jacket athletic",
    "Cotton T-Shirt": "cotton t-shirt clothing",
    "Wool Beanie": "wool beanie hat",
    "Yoga Leggings": "yoga leggings pants",
    "Rain Poncho": "rain poncho waterproof",
    "Hiking Socks": "hiking socks wool",
    "Fleece Hoodie": "fleece hoodie jacket",
    "Canvas Sneakers": "canvas sneakers shoes",
    "Yoga Mat": "yoga mat exercise",
    "Insulated Water Bottle": "insulated water bottle steel",
    "Resistance Bands Set": "resistance band exercise",
    "Facial Serum": "facial serum bottle skincare",
    "Bamboo Hairbrush": "wooden hairbrush",
    "Sunscreen Lotion": "sunscreen bottle lotion",
    "Lip Balm Set": "lip balm stick",
    "Clay Face Mask": "clay face mask jar skincare",
    "Electric Toothbrush": "electric toothbrush",
    "Body Wash": "body wash bottle",
    "Hair Dryer": "hair dryer blow dryer appliance",
    "Wooden Puzzle": "wooden jigsaw puzzle",
    "Plush Toy": "plush toy stuffed animal",
    "Modeling Clay Kit": "modeling clay kit toy",
    "Science Experiment Kit": "science kit toy",
    "Stacking Rings": "stacking rings toy baby",
    "Organic Trail Mix": "trail mix nuts snack",
    "Cold-Brew Coffee Bags": "cold brew coffee bag",
    "Herbal Tea Sampler": "herbal tea bags box",
    "Whole Grain Pasta": "pasta box whole grain",
    "Granola Cereal": "granola cereal box",
    "Sparkling Water Pack": "sparkling water bottles",
    "Nut Butter Jar": "peanut butter jar",
    "Desk Organizer": "desk organizer office supplies",
    "Notebook Set": "notebook stationery",
    "Standing Desk Converter": "standing desk converter riser",
    "Whiteboard": "whiteboard dry erase board",
    "Filing Cabinet": "filing cabinet office",
    "Cable Management Tray": "cable management box",
    "Desk Lamp": "led desk lamp office",
    "Ergonomic Chair Cushion": "office chair seat cushion",
    "Dog Chew Toy": "dog chew toy",
    "Cat Scratching Post": "cat scratching post",
    "Pet Carrier": "pet carrier travel bag",
    "Orthopedic Pet Bed": "dog bed orthopedic foam",
    "Pet Water Fountain": "pet water fountain bowl",
    "Training Treat Pouch": "dog treat pouch training",
    "Building Block Set": "toy building blocks",
    "Coffee Grinder": "electric coffee grinder machine",
}

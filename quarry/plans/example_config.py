"""Example configuration of a dedup run: the lists and maps of one corpus of restaurant groups."""

from quarry.functions.noise import NoiseRules

#: Slugs, patterns (on name or slug), brand prefixes and words that mark an entity as noise.
EXAMPLE = NoiseRules(
    slugs=[
        "contact-form-7", "501-c-3", "gift-cards", "happy-hour", "sake", "sushi", "sashimi", "teppanyaki", "lifestyle-menu", "power-lunch", "power-lunch-menu",
        "restaurant-week", "endless-holiday-menu", "dare-to-brunch", "magnum-mondays", "steak-night-america", "steak-night-milan", "las-vegas-steak-night", "denver-menu",
    ],
    patterns=[
        "roll$", "soup$", "salad$", "bowl$", "bao$", "slider$", "burrito$", "meatloaf$", "salmon$", "steak$", "filet$", "lobster", "chicken$", "shrimp$", "gyoza$", "tempura",
        "wagyu.*filet", "wagyu.*broil", "wagyu.*slider", "fried rice$", "ceviche$", "poke$", "wontons$", "katsu$", "teriyaki$", "ra-men$", "yakisoba$", "mochi$", "cr-me br-l-e$",
        "hibachi.*chicken$", "hibachi.*shrimp$", "hibachi.*steak$", "hibachi.*supreme$", "hibachi.*chateaubriand$", "hibachi.*rice$", "hibachi.*filet", "hibachi.*burritos$",
        "platter$", "punch bowl$",
        "vodka$", "tequila$", "merlot$", "prosecco$", "pinot grigio$", "cabernet$", "sauvignon blanc$", "lager$", "ale$", "ipa$", "seltzer$", "ultra$", "martini$", "margarita$",
        "lemonade$", "champagne$", "brut$", "sparkling$", "ros[eé]$", "plum wine$", "sake$", "nigori$", "ginjo$",
    ],
    prefixes=[
        "absolut", "casamigos", "patron", "don-julio", "grey-goose", "reyka", "skyy", "corona", "sapporo", "asahi", "kirin", "stella-artois", "michelob", "high-noon", "hitachino",
        "orion", "golden-road", "austin-beerworks", "athletic-golden", "hakutsuru", "hakkaisan", "heavensake", "kizakura", "amabuki", "kubota", "joto", "veuve-clicquot",
        "laurent-perrier", "ferrari-brut", "ferrari-ros", "la-marca", "mionetto", "kim-crawford", "bonanza", "caposaldo", "santa-margherita", "woodbridge", "brush-creek",
        "a-to-z-rose", "14-hands", "dom-perignon", "dom-p-rignon", "mo-t-chandon", "grand-marnier", "ancho-reyes", "monin", "maker", "poland-spring", "ramune",
        "hana-flavored-sake", "kinsen-plum-wine", "mio-sparkling", "mio", "sho-chiku-bai", "shimizu-no-mai", "kawaba", "kyoto-matcha",
    ],
    slug_patterns=[
        "^benihana-(fried-rice|ginger-sauce|garlic-sauce|yum-yum|onion-soup|mojito|plum|punch|sake|inspired)", "^kona-grill-(baltimore|huntsville|north-star|tampa)$",
    ],
    promotions=[
        "ra-sushi-gift-cards", "benihana-gift-cards",
        "be-the-chef", "taste-of-benihana", "taste-of-benihana-menu", "taste-of-kona", "kabuki-kids", "kabuki-kids-menu", "kabuki-sushi", "sushi-garden", "sushi-me",
        "sushi-sake-101", "sushi-sake-201", "ocean-treasure", "rising-sun-platter", "tokyo-platter", "bounty-of-the-seven-seas", "wagyu-of-the-world", "fishbowl-cocktails",
        "splash-n-meadow", "blue-ocean-punch-bowl", "blue-samurai-punch-bowl", "beni-tini", "tokyo-mule", "dirty-bull", "catch-me-if-you-can", "nectar-slider", "dojo-sushi",
        "ra-ckin-for-nicky", "ra-ckin-roll", "salt-water-social", "26-steak-date", "3-6-9-happy-hour", "7-7-7-happy-hour", "samurai-restaurant", "hibachi-supreme",
        "rooftop-by-stk", "vibe-dining", "stk-steakhouse-atlanta", "stk-steakhouse-niagara-fallsview",
    ],
    described=r"(menu item|cocktail|dish|appetizer|dessert|entrée|entree|beverage|drink|beer|wine|sake|spirit)",
    real=["organization", "person"],
)

#: Variants of slugs and the slugs that they are merged into.
MERGES = [
    ("the-one", "the-one-group-hospitality"), ("tog", "the-one-group-hospitality"), ("togrp", "the-one-group-hospitality"), ("togrp-com", "the-one-group-hospitality"),
    ("one-hospitality", "the-one-group-hospitality"), ("benihana-national", "benihana"), ("stk", "stk-steakhouse"), ("open-table", "opentable"),
    ("friends-with-benefits-loyalty-program", "friends-with-benefits"), ("friends-with-benefits-rewards", "friends-with-benefits"), ("dom-p-rignon", "dom-perignon"),
    ("the-cosmopolitan-of-las-vegas", "the-cosmopolitan"), ("st-jude-children", "st-jude"), ("the-chef", "the-chefs-table"), ("mio-sparkling-sake", "mio-sparkling"),
    ("stk-downtown", "stk-nyc-downtown"),
]
#: Slugs and the beginnings of the batches whose version of them is preferred.
HOMES = [
    ("the-one-group-hospitality", "togrp.com"), ("benihana", "benihana.com"), ("kona-grill", "konagrill.com"), ("ra-sushi", "rasushi.com"), ("stk-steakhouse", "stksteakhouse.com"),
    ("bao-yum", "baoyum.com"), ("friends-with-benefits", "togrp.com"), ("salt-water-social", "togrp.com"), ("samurai", "togrp.com"), ("chassis", "togrp.com"), ("opentable", "togrp.com"),
    ("fanatic-design", "togrp.com"), ("font-awesome", "benihana.com"), ("fonticons", "benihana.com"), ("mapbox", "benihana.com"),
    ("web-content-accessibility-guidelines-wcag", "togrp.com"), ("stk-london", "stksteakhouse.com"), ("stk-milan", "stksteakhouse.com"), ("valentine", "benihana.com"),
]

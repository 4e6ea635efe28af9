"""Fixed values the jobs depend on: word lists, lookup rows and defaults."""

# Columns that hold text in a raw review file.
TEXT_COLUMNS = (
    "country", "description", "designation", "province", "region_1", "region_2",
    "taster_name", "taster_twitter_handle", "title", "variety", "winery",
)

# Raw columns that no later step uses.
UNUSED_COLUMNS = ("Unnamed: 0", "designation", "region_2", "taster_twitter_handle")

# Cell texts that a CSV scan reads as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Producers whose country is known and overrides the file.
WINERY_COUNTRY = {
    "Gotsa Family Wines": "Georgia",
    "Barton & Guestier": "France",
    "Kakhetia Traditional Winemaking": "Georgia",
    "Tsililis": "Greece",
    "Ross-idi": "Bulgaria",
    "Les Frères Dutruy": "Switzerland",
    "El Capricho": "Spain",
    "Büyülübağ": "Turkey",
    "Psagot": "Israel",
    "Orbelus": "Bulgaria",
    "St. Donat": "Hungary",
    "Familia Deicas": "Uruguay",
    "Bartho Eksteen": "South Africa",
    "Stone Castle": "Kosovo",
    "Teliani Valley": "Georgia",
    "Undurraga": "Chile",
    "Mt. Beautiful": "New Zealand",
    "Neumeister": "Austria",
    "Bachelder": "Canada",
    "Chilcas": "Chile",
    "Santa Ema": "Chile",
    "Newton Johnson": "South Africa",
    "Ktima Voyatzi": "Greece",
    "Lismore": "South Africa",
    "Logodaj": "Bulgaria",
    "Somlói Vándor": "Hungary",
    "Amiran Vepkhvadze": "Georgia",
}

# Fill-ins for missing cells.
DEFAULT_VARIETY = "Cabernet Sauvignon"
UNKNOWN = "unknown"

# Phrases that stand for a sort order (position breaks ties).
ANCHORS = (
    ("cheap inexpensive low price budget affordable value wine", "price", True),
    ("expensive high price premium luxury costly splurge wine", "price", False),
    ("highly rated top rated best rated high score critically acclaimed", "points", False),
    ("low rated poorly rated bad reviews weak score", "points", True),
)
ANCHOR_THRESHOLD = 0.5
BLEND_WEIGHT = 0.35

# Filter texts that mean "no filter".
NO_FILTER_VALUES = ("", "any", "all", "none", "n/a")

# Request defaults; the nearest-first stage fetches max(5 * k, 20).
DEFAULT_TOP_K = 5
OVERFETCH_FACTOR = 5
OVERFETCH_MIN = 20

# The short list of grape names offered as a filter.
RED_VARIETIES = (
    "pinot noir", "cabernet sauvignon", "merlot", "syrah", "shiraz", "malbec", "zinfandel",
    "sangiovese", "tempranillo", "grenache", "nebbiolo", "cabernet franc", "petite sirah",
    "red blend",
)
WHITE_VARIETIES = (
    "chardonnay", "sauvignon blanc", "riesling", "pinot grigio", "pinot gris", "gewurztraminer",
    "viognier", "chenin blanc", "moscato", "white blend", "gruner veltliner",
)

# Words that put a variety in a style, found as whole words and tested in
# this order.
SPARKLING_WORDS = (
    "sparkling", "champagne", "prosecco", "glera", "cava", "cremant", "crémant", "frizzante", "asti",
)
ROSE_WORDS = ("rosé", "rose", "rosado", "rosato", "moscato rosa", "rosenmuskateller")
RED_WORDS = (
    "pinot noir", "pinot nero", "spätburgunder", "cabernet sauvignon", "cabernet franc",
    "cabernet", "merlot", "syrah", "shiraz", "malbec", "zinfandel", "primitivo",
    "sangiovese", "tempranillo", "tinta roriz", "tinto fino", "tinto del pais", "tinto velasco", "tinta del pais",
    "tinta del toro", "tinta de toro", "grenache", "garnacha", "cannonau", "nebbiolo", "barbera",
    "montepulciano", "nero d'avola", "nero di troia", "aglianico", "touriga nacional", "touriga franca",
    "touriga", "baga", "tannat", "carignan", "carignane", "carignano",
    "cariñena", "mourvèdre", "monastrell", "mataro", "gamay", "dolcetto", "corvina", "rondinella",
    "molinara", "negroamaro", "blaufränkisch", "kékfrankos", "kekfrankos", "frankovka", "zweigelt",
    "xinomavro", "agiorgitiko", "mavrud", "mavrodaphne", "mavrokalavryta", "mavrotragano", "mavroudi",
    "saperavi", "carmenère", "pinotage", "lagrein", "teroldego", "refosco", "marzemino", "freisa",
    "grignolino", "dornfelder", "lemberger", "st. laurent", "portugieser", "mencía", "graciano", "bobal",
    "alicante", "castelão", "trincadeira", "jaen", "aragonez", "aragonês", "ramisco", "tinta barroca",
    "tinta cao", "tinta madeira", "tinta miúda", "tinta negra mole", "vranac", "vranec",
    "plavac mali", "babić", "teran", "kadarka", "blauburger", "blauburgunder", "frühburgunder",
    "früburgunder", "schiava", "lambrusco", "rara neagra", "susumaniello", "gaglioppo", "sagrantino",
    "ciliegiolo", "colorino", "canaiolo", "pugnitello", "prugnolo gentile", "malvasia nera", "petite sirah",
    "petite verdot", "petit verdot", "red blend", "claret", "meritage", "g-s-m", "bordeaux-style red",
    "rhône-style red", "provence red", "austrian red", "portuguese red", "port", "trollinger", "bonarda",
    "nerello mascalese", "nerello cappuccio", "pinot meunier", "cinsault", "frappato", "charbono",
    "negrette", "norton", "baco noir", "prieto picudo", "alfrocheiro", "brachetto", "piedirosso", "kalecik karasi",
    "raboso", "mondeuse", "uva di troia", "counoise", "ruché", "trepat", "okuzgozu", "feteasca neagra",
    "gragnano", "chambourcin", "jacquez", "chancellor", "marquette", "st. vincent", "marselan", "mazuelo",
    "mansois", "duras", "braucol", "sirica", "sciaccerellu", "nielluciu", "melnik", "kotsifali",
    "tsapournakos", "papaskarasi", "karasakiz", "boğazkere", "çalkarası", "žilavka", "sousão", "souzao",
    "vinhão", "tinta francisca", "tinta amarela", "tinta fina", "tintilia", "morava",
    "listán negro", "grolleau", "groppello", "magliocco", "manzoni", "perricone",
    "poulsard", "trousseau", "abouriou", "cesanese", "durif", "alvarelhão", "aleatico", "albarossa",
    "argaman", "bastardo", "blatina", "bovale", "carcajolu", "carineña", "casavecchia", "centesimino",
    "chelois", "fer servadou", "forcallà", "franconia", "gamza", "mandilaria", "mission", "país",
    "monica", "otskhanuri sapere", "ojaleshi", "parraleta", "pignolo", "portuguiser", "prunelard", "rebo",
    "rufete", "schwartzriesling", "valdiguié", "kuntra", "vespolina",
    "noir", "nero", "nera", "rosso", "tinta", "tinto", "black", "negro", "kara",
)
WHITE_WORDS = (
    "chardonnay", "sauvignon blanc", "sauvignon", "riesling", "pinot grigio", "pinot gris", "pinot blanc",
    "pinot bianco", "gewürztraminer", "gewurztraminer", "traminer", "traminette", "viognier", "chenin blanc", "moscato", "muscat", "muscatel", "moscatel",
    "white blend", "gruner veltliner", "grüner veltliner", "veltliner", "albariño", "albarino", "verdejo", "vermentino", "trebbiano",
    "garganega", "cortese", "falanghina", "fiano", "semillon", "sémillon", "torrontés", "grecanico",
    "grechetto", "greco", "godello", "arinto", "encruzado", "loureiro", "arneis", "friulano", "malvasia",
    "verdicchio", "vernaccia", "picpoul", "picolit", "colombard", "ugni blanc", "folle blanche", "chasselas",
    "silvaner", "sylvaner", "müller-thurgau", "kerner", "scheurebe", "furmint", "hárslevelü",
    "welschriesling", "graševina", "grasevina", "assyrtiko", "assyrtico", "roditis", "malagousia",
    "malagouzia", "vidal", "vidal blanc", "seyval blanc", "chardonel", "cayuga", "niagara", "diamond", "catawba", "symphony", "sacy",
    "elbling", "kisi", "rkatsiteli", "mtsvane", "chinuri", "carricante", "insolia", "inzolia",
    "catarratto", "grillo", "zibibbo", "moscato giallo", "cerceal", "fernão pires", "antão vaz", "gouveio", "rabigato",
    "viosinho", "loureiro-arinto", "azal", "avesso", "trajadura", "bical", "maria gomes", "malvar", "airen", "verdil",
    "xarel-lo", "macabeo", "treixadura", "verdelho", "verdello", "boal", "bual", "sercial", "terrantez",
    "white port", "biancolella", "grauburgunder", "weissburgunder", "auxerrois", "savagnin", "petit manseng",
    "gros manseng", "gros and petit manseng", "melon", "viura", "turbiana", "roussanne", "marsanne",
    "fumé blanc", "pedro ximénez", "moschofilero", "jacquère", "muskateller", "muskat", "hondarrabi zuri",
    "rotgipfler", "passerina", "palomino", "pansa blanca", "zierfandler", "tocai", "morillon",
    "muscadelle", "muscadine", "muscadel", "nosiola", "posip", "durella", "pallagrello bianco", "sherry", "clairette",
    "erbaluce", "favorita", "mauzac", "alvarinho", "pecorino", "ribolla gialla", "tokaji", "tokay",
    "aligoté", "albana", "albanello", "siria", "vignoles", "coda di volpe", "códega do larinho",
    "romorantin", "verduzzo", "rebula", "robola", "torontel", "nasco", "nuragus", "pignoletto",
    "sauvignonasse", "savatiano", "verdeca", "vespaiolo", "picapoll", "timorasso", "vitovska", "vilana",
    "torbato", "premsal", "pigato", "narince", "nascetta", "neuburger", "mantonico", "tamianka",
    "tamjanika", "misket", "gros plant", "edelzwicker", "madeleine angevine", "irsai oliver",
    "rieslaner", "rivaner", "sämling", "siegerrebe", "ryzlink rýnský", "thrapsathiri", "tsolikouri",
    "tămâioasă românească", "xinisteri", "xynisteri", "yapincak", "zlahtina", "marawi", "jampal",
    "loin de l'oeil", "moscadello", "debit", "dafni", "catalanesca", "biancale", "asprinio", "athiri",
    "altesse", "ansonica", "cococciola", "emir", "feteasca", "feteascǎ regalǎ", "paralleda", "rolle",
    "petit courbu", "cercial", "aidani", "caprettone",
    "bianco", "bianca", "blanc", "blanca", "blanco", "white",
)
STYLE_WORDS = {"sparkling": SPARKLING_WORDS, "rosé": ROSE_WORDS, "red": RED_WORDS, "white": WHITE_WORDS}

# Country names written in capitals.
COUNTRY_OVERRIDES = {"us": "US", "uk": "UK", "usa": "USA", "uae": "UAE"}

# Lowest points of the rating buckets 5, 4, 3 and 2.
RATING_FLOORS = ((95, 5), (90, 4), (87, 3), (84, 2))

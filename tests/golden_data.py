"""Fixed values for the golden tests: menu terms, rewrite rules and their expected effects."""

# --- fixed values: lang, term, canonical, in menu order ---
MENU = [
    ("es", "hamburguesa clásica", "hamburguesa clásica"),
    ("es", "hamburguesa", "hamburguesa clásica"),
    ("es", "burger", "hamburguesa clásica"),
    ("es", "hamburguesa con queso", "hamburguesa con queso"),
    ("es", "papas fritas", "papas fritas"),
    ("es", "papas", "papas fritas"),
    ("es", "fritas", "papas fritas"),
    ("es", "sopa", "sopa"),
    ("es", "ensalada", "ensalada"),
    ("es", "ensalada verde", "ensalada"),
    ("es", "agua", "agua"),
    ("es", "botella de agua", "agua"),
    ("es", "café", "café"),
    ("es", "café con leche", "café con leche"),
    ("es", "té helado", "té helado"),
    ("es", "mesa", "mesa"),
    ("es", "plato", "plato"),
    ("es", "tenedor", "tenedor"),
    ("es", "cuchillo", "cuchillo"),
    ("es", "servilleta", "servilleta"),
    ("es", "cocina", "cocina"),
    ("es", "hielo", "hielo"),
    ("en", "classic burger", "classic burger"),
    ("en", "burger", "classic burger"),
    ("en", "fries", "fries"),
    ("en", "french fries", "fries"),
    ("en", "soup", "soup"),
    ("en", "steak wrap", "steak wrap"),
    ("en", "steak", "steak wrap"),
    ("en", "coffee", "coffee"),
    ("en", "check", "check"),
    ("en", "bill", "bill"),
    ("en", "fork", "fork"),
    ("en", "knife", "knife"),
    ("en", "napkin", "napkin"),
]

# --- fixed values: id, lang, wrong, right, context_any, context_none, status ---
RULES = [
    ("es-0001", "es", "tejedor", "tenedor",
     ["me", "da", "un", "quiero", "trae", "cuchillo", "mesa"], [], "active"),
    ("es-0002", "es", "bocina", "cocina",
     ["de", "la", "en", "plato", "chef"], ["auto", "coche", "carro"], "active"),
    ("es-0003", "es", "silueta", "servilleta",
     ["una", "me", "da", "trae", "pasa", "servilletas"], [], "active"),
    ("es-0004", "es", "gafé", "café",
     ["un", "el", "quiero", "me", "con", "leche"], [], "active"),
    ("es-0005", "es", "plazo", "plato",
     ["un", "el", "de", "quiero", "me", "comida"], ["pago", "cuota", "banco"], "approved"),
    ("es-0006", "es", "ropa", "sopa",
     ["una", "de", "quiero", "caliente", "del", "día"], ["lavar", "sucia", "tienda"], "approved"),
    ("es-0007", "es", "cielo", "hielo",
     ["con", "de", "agua", "sin", "cubitos"], ["azul", "nube", "estrella"], "approved"),
    ("es-0008", "es", "polvo", "pollo",
     ["de", "un", "quiero", "asado", "frito"], ["limpiar", "tierra"], "approved"),
    ("en-0003", "en", "flies", "fries",
     ["and", "of", "order", "some", "with", "please"],
     ["bug", "insect", "swarm", "buzzing"], "active"),
    ("en-0002", "en", "folk", "fork",
     ["a", "and", "knife", "spoon", "give", "napkin"],
     ["music", "song", "people", "singer"], "approved"),
    ("en-0006", "en", "deck", "check",
     ["bring", "pay", "split", "please", "our"], ["ship", "boat", "cards", "pool"], "approved"),
    ("en-0007", "en", "pill", "bill",
     ["bring", "pay", "split", "please", "our"],
     ["take", "doctor", "medicine", "swallow"], "approved"),
    ("en-0008", "en", "snake", "steak",
     ["order", "grilled", "medium", "rare", "cooked"],
     ["zoo", "venom", "reptile", "grass"], "approved"),
]

# --- fixed values: lang, rule, text, expected text, mode, fires ---
CASES = [
    ("es", "es-0001", "me da un tejedor", "me da un tenedor", "replace", True),
    ("es", "es-0001", "el tejedor trabaja en la fabrica",
     "el tejedor trabaja en la fabrica", "replace", False),
    ("es", "es-0002", "algo de la bocina", "algo de la cocina", "replace", True),
    ("es", "es-0002", "toca la bocina del auto", "toca la bocina del auto", "replace", False),
    ("es", "es-0003", "me da una silueta", "me da una servilleta", "replace", True),
    ("es", "es-0003", "la silueta del vestido", "la silueta del vestido", "replace", False),
    ("es", "es-0004", "quiero un gafe con leche", "quiero un café con leche", "replace", True),
    ("es", "es-0004", "gafe", "gafe", "replace", False),
    ("es", "es-0005", "quiero un plazo de comida", "quiero un plazo de comida", "log_only", True),
    ("es", "es-0005", "el plazo de pago del banco",
     "el plazo de pago del banco", "log_only", False),
    ("es", "es-0006", "quiero una ropa caliente", "quiero una ropa caliente", "log_only", True),
    ("es", "es-0006", "voy a lavar la ropa sucia", "voy a lavar la ropa sucia", "log_only", False),
    ("es", "es-0007", "agua con cielo", "agua con cielo", "log_only", True),
    ("es", "es-0007", "el cielo azul con nubes", "el cielo azul con nubes", "log_only", False),
    ("es", "es-0008", "quiero un polvo asado", "quiero un polvo asado", "log_only", True),
    ("es", "es-0008", "limpiar el polvo de tierra",
     "limpiar el polvo de tierra", "log_only", False),
    ("en", "en-0003", "order some flies please", "order some fries please", "replace", True),
    ("en", "en-0003", "the flies swarm outside", "the flies swarm outside", "replace", False),
    ("en", "en-0002", "give me a folk and knife", "give me a folk and knife", "log_only", True),
    ("en", "en-0002", "i love folk music", "i love folk music", "log_only", False),
    ("en", "en-0006", "bring our deck please", "bring our deck please", "log_only", True),
    ("en", "en-0006", "cards on the deck of the ship",
     "cards on the deck of the ship", "log_only", False),
    ("en", "en-0007", "pay the pill please", "pay the pill please", "log_only", True),
    ("en", "en-0007", "take a pill for the doctor",
     "take a pill for the doctor", "log_only", False),
    ("en", "en-0008", "order a snake grilled", "order a snake grilled", "log_only", True),
    ("en", "en-0008", "a snake at the zoo", "a snake at the zoo", "log_only", False),
]

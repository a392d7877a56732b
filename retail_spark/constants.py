"""Fixed values the store's data uses. They are data, so they keep the store's language."""

# Order statuses.
ORDER_STATUSES = [
    "Pendiente de Pago",
    "Pagado",
    "Procesando",
    "Enviado",
    "Entregado",
    "Cancelado",
    "Pendiente de Confirmacion",
]
SOLD_STATUSES = ["Pagado", "Entregado", "Enviado"]
SETTLED_STATUSES = ["Pagado", "Entregado"]
PENDING_STATUSES = ["Pendiente de Pago", "Pendiente de Confirmacion"]

# Payment methods, and the status an order gets from its method.
CASH_ON_DELIVERY = "ContraEntrega"
WOMPI = "Wompi"
NAMELESS_PAYER = "Cliente Wompi"
PAYPAL = "PayPal"
STATUS_OF_NEW_CASH_ORDER = "Pendiente de Confirmacion"
STATUS_OF_NEW_PAID_ORDER = "Pagado"

# Payment event statuses.
APPROVED = "APPROVED"
CLOSING_STATUSES = ["DECLINED", "VOIDED", "ERROR"]
PAYMENT_LIFETIME_MINUTES = 30

# Account roles, and statuses of contact messages.
ROLES = ["admin", "cliente"]
DEFAULT_ROLE = "cliente"
MESSAGE_STATUSES = ["read", "unread", "archived"]

# Default site settings. The welcome title and the contact address
# carry the store's own name, which the caller supplies.
COLOUR_AND_TEXT_DEFAULTS = {
    "colorPrimary": "#ea580c",
    "colorSecondary": "#047857",
    "colorAccent": "#f1f5f9",
    "promoBannerTitle": "¡Ofertas Imperdibles!",
    "promoBannerText": "Descuentos especiales en herramientas seleccionadas.",
    "contactAddress": "Calle Falsa 123, Barranquilla, Colombia",
    "contactPhone": "+57 300 123 4567",
    "socialFacebook": "",
    "socialTwitter": "",
    "socialInstagram": "",
    "socialYoutube": "",
}
SETTING_KEYS = [
    "colorPrimary",
    "colorSecondary",
    "colorAccent",
    "welcomeTitle",
    "promoBannerTitle",
    "promoBannerText",
    "contactAddress",
    "contactPhone",
    "contactEmail",
    "socialFacebook",
    "socialTwitter",
    "socialInstagram",
    "socialYoutube",
]
STORE_NAME = "Tienda"

# Texts shown for missing data.
CAROUSEL_BLURB = "Excelente producto para tus proyectos."
GALLERY_PLACEHOLDER = "https://placehold.co/600x400/e5e7eb/4b5563?text=NI"
FALLBACK_COP_PER_USD = 4000


def setting_defaults(store_name: str = STORE_NAME) -> dict[str, str]:
    """The 13 default settings of a store with the given name."""
    defaults = dict(COLOUR_AND_TEXT_DEFAULTS)
    defaults["welcomeTitle"] = f"Bienvenido a {store_name}"
    defaults["contactEmail"] = f"info@{store_name.lower()}.example.com"
    return {key: defaults[key] for key in SETTING_KEYS}

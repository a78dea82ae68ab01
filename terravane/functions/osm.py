"""Which map tags are accepted, and which venue categories they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The columns of the node table.
COLUMNS = ("id", "lat", "lon", "name", "amenity", "building", "url", "atm", "craft", "emergency", "highway", "historic", "leisure", "office", "public_transport", "transport", "railway", "network", "operator", "station", "shop", "sport", "tourism", "internet_access", "opening_hours", "charge", "phone", "website")
#: Keys of which all values are accepted, some only, or all but some.
ANY = ("name", "office", "public_transport", "transport", "operator", "station", "shop", "sport", "internet_access", "opening_hours", "phone", "website", "url", "atm")
ONLY = {
    "emergency": ("phone",),
    "highway": ("bus_stop",),
    "railway": ("platform", "station", "subway_entrance", "tram_stop", "subway"),
}
EXCEPT = {
    "amenity": ("waste_disposal", "waste_basket", "bench", "playground", "register_office", "beauty", "studio", "trolley_stop", "collection office", "biergarten", "fitness_center", "educational_centre", "grave_yard", "printing_establishment", "bank;atm", "internet", "clockshop", "waste_transfer_station", "bank,bureau_de_change", "business", "languages_school", "beauty_salon", "soccer_club", "notary", "vehicle_inspection", "senior_house", "bus_stop  k100 k18\\n", "exchange", "internet_cafe", "compressed_air", "dance", "mending", "mortuary", "casino", "spa", "exhibition_center", "credit", "language_school", "stripclub", "offices"),
    "building": ("entrance", "gate", "toilets", "apartments", "public", "industrial", "dormitory"),
    "craft": ("hvac", "shoemaker;key_cutter;electronics", "beekeeper", "basket_maker", "glasiery", "optician", "shoemaker; tailor; key_cutter", "computer", "shoemaker; dressmaker; key_cutter", "carpenter", "gardener", "furniture", "scrapbooking", "stamp", "shoemaker;tailor;key_cutter", "teilor", "tailor; key_cutter", "locksmith"),
    "historic": ("ruins", "milestone", "wayside_cross", "manor", "yes"),
    "leisure": ("water_park", "pitch", "track", "swimming_pool", "stadium", "slipway", "Детская площадка ", "marina", "ice_rink", "park", "sauna", "ice_cream"),
    "network": ("Кронверк Синема", "Торговая сеть «Жемчужина Японии»"),
    "tourism": ("caravan_site", "gallery", "picnic_site", "guest_house", "museum arhiv", "motel", "yes", "camp_site"),
}
#: Categories that rules give, in the order in which a place lists them.
CATEGORIES = ("Arts & Entertainment", "Art Gallery", "Museum", "Movie Theater", "Performing Arts Venue", "College & University", "Food", "Bakery", "Cafe", "Fast Food Restaurant", "Restaurant", "Professional & Other Places", "Government Building", "Library", "Medical Center", "Office", "Parking", "Post Office", "Spiritual Center", "Nightlife Spot", "Bar", "Pub", "Club House", "Other Great Outdoors", "Shop & Service", "Arts & Crafts Store", "ATM", "Bank", "Bookstore", "Car Dealership", "Car Wash", "Clothing Store", "Convenience Store", "Daycare", "Drugstore / Pharmacy", "Electronics Store", "Flower Shop", "Food & Drink Shop", "Furniture / Home Store", "Gas Station / Garage", "Gift Shop", "Gym / Fitness Center", "Hardware Store", "Jewelry Store", "Market", "Mobile Phone Shop", "Pet Service", "Pet Store", "Salon / Barbershop", "Sporting Goods Shop", "Toy / Game Store", "Travel Agency", "Travel & Transport", "Hotel", "Subway", "Bus Stop", "Train Station", "Tram", "Platform")
#: Categories of a tag by its value; "" holds for every value of the key.
RULES = {
    "amenity": {
        "bar": ("Bar", "Nightlife Spot"), "pub": ("Pub", "Nightlife Spot"), "Club House": ("Nightlife Spot", "Club House"), "fuel": ("Shop & Service", "Gas Station / Garage"),
        "place_of_worship": ("Spiritual Center", "Professional & Other Places"), "post_office": ("Post Office", "Professional & Other Places"), "bank": ("Shop & Service", "Bank"),
        "library": ("Professional & Other Places", "Library"), "cinema": ("Arts & Entertainment", "Movie Theater"), "atm": ("Shop & Service", "ATM"), "restaurant": ("Food", "Restaurant"),
        "fast_food": ("Food", "Fast Food Restaurant"), "food_court": ("Food", "Fast Food Restaurant"), "cafe": ("Food", "Cafe"), "nightclub": ("Nightlife Spot", "Club House"),
        "pharmacy": ("Shop & Service", "Drugstore / Pharmacy"), "kindergarten": ("Shop & Service", "Daycare"), "university": ("College & University",), "college": ("College & University",),
        "parking": ("Professional & Other Places", "Parking"), "car_wash": ("Shop & Service", "Car Wash"), "police": ("Professional & Other Places", "Government Building"),
        "fountain": ("Other Great Outdoors",), "courthouse": ("Government Building",), "theatre": ("Arts & Entertainment", "Performing Arts Venue"), "veterinary": ("Pet Service", "Shop & Service"),
        "collection office": ("Professional & Other Places", "Office"), "marketplace": ("Shop & Service", "Market"), "hospital": ("Professional & Other Places", "Medical Center"),
        "dentist": ("Professional & Other Places", "Medical Center"), "clinic": ("Professional & Other Places", "Medical Center"), "doctors": ("Professional & Other Places", "Medical Center"),
        "beauty": ("Shop & Service",),
    },
    "atm": {"yes": ("ATM", "Shop & Service")},
    "craft": {"": ("Arts & Crafts Store", "Shop & Service")},
    "leisure": {"sports_centre": ("Shop & Service", "Gym / Fitness Center")},
    "office": {"": ("Office", "Professional & Other Places")},
    "transport": {
        "subway": ("Travel & Transport", "Subway"), "subway_entrance": ("Travel & Transport", "Subway"), "tram_stop": ("Travel & Transport", "Tram"),
        "platform": ("Travel & Transport", "Train Station", "Platform"), "bus_stop": ("Travel & Transport", "Bus Stop"), "stop_position": ("Travel & Transport", "Bus Stop"), "station": ("Travel & Transport", "Bus Stop"),
    },
    "shop": {
        "": ("Shop & Service",), "convenience": ("Convenience Store",), "supermarket": ("Food & Drink Shop",), "clothes": ("Clothing Store",), "hairdresser": ("Salon / Barbershop",),
        "florist": ("Flower Shop",), "shoes": ("Clothing Store",), "mobile_phone": ("Mobile Phone Shop",), "furniture": ("Furniture / Home Store",), "jewelry": ("Jewelry Store",),
        "hardware": ("Hardware Store",), "alcohol": ("Food & Drink Shop",), "electronics": ("Electronics Store",), "computer": ("Electronics Store",), "books": ("Bookstore",), "pet": ("Pet Store",),
        "car": ("Car Dealership",), "bakery": ("Bakery",), "sports": ("Sporting Goods Shop",), "toys": ("Toy / Game Store",), "gift": ("Gift Shop",), "travel_agency": ("Travel Agency",),
    },
    "tourism": {
        "hotel": ("Travel & Transport", "Hotel"), "hostel": ("Travel & Transport", "Hotel"), "museum": ("Arts & Entertainment", "Museum"),
        "artwork": ("Arts & Entertainment", "Art Gallery"), "attraction": ("Arts & Entertainment",),
    },
}
#: Fixed value: an amenity whose value holds this text anywhere, and is none of the values above.
SCHOOL = ("school", "College & University")


def accepted(key: Column, value: Column) -> Column:
    """Whether a tag is kept. Keys without a policy are not."""
    out = key.isin(*ANY)
    for k, values in ONLY.items():
        out = out | ((key == k) & value.isin(*values))
    for k, values in EXCEPT.items():
        out = out | ((key == k) & ~value.isin(*values))
    return F.coalesce(out & value.isNotNull(), F.lit(False))


def _given(category: str) -> Column:
    """Whether a place, by its columns, gets the category."""
    out = F.lit(False)
    for key, values in RULES.items():
        exact = [v for v, names in values.items() if v and category in names]
        if category in values.get("", ()):
            out = out | F.col(key).isNotNull()
        if exact:
            out = out | F.coalesce(F.col(key).isin(*exact), F.lit(False))
        if key == "amenity" and category == SCHOOL[1]:
            out = out | F.coalesce(F.contains(key, F.lit(SCHOOL[0])) & ~F.col(key).isin(*values), F.lit(False))
    return out


def categories() -> Column:
    """The categories of a place as an ordered array; its columns are those of the rules' keys."""
    return F.filter(F.array(*[F.when(_given(c), F.lit(c)) for c in CATEGORIES]), lambda x: x.isNotNull())


def transport_kind() -> Column:
    return F.coalesce("highway", "transport", "station", "railway", "public_transport")


def run_by() -> Column:
    return F.coalesce("network", "operator")

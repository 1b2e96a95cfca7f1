"""Fixed values.

The literals below must equal the ones the original analyses use, because they are compared with
data (urls, traffic-source values, device names) or appear in results (period and segment labels,
the lift constant). They are stated here once, plainly and in the order the analyses use them;
operators take them as parameters and only default to these.
"""

# --- fixed values: page urls -------------------------------------------------------------------
HOME = "/home"
LANDER_1 = "/lander-1"
LANDER_2 = "/lander-2"
PRODUCTS = "/products"
MR_FUZZY = "/the-original-mr-fuzzy"
LOVE_BEAR = "/the-forever-love-bear"
CART = "/cart"
SHIPPING = "/shipping"
BILLING = "/billing"
BILLING_2 = "/billing-2"
THANK_YOU = "/thank-you-for-your-order"

# --- fixed values: traffic segments ------------------------------------------------------------
GSEARCH = "gsearch"
BSEARCH = "bsearch"
BRAND = "brand"
NONBRAND = "nonbrand"
DESKTOP = "desktop"
MOBILE = "mobile"

# --- fixed values: result labels ---------------------------------------------------------------
MONDAY_LABEL = "Monday"
TUESDAY_LABEL = "Tuesday"
OTHER_DAY_LABEL = "other day"
SAW_HOMEPAGE = "saw_homepage"
SAW_CUSTOM_LANDER = "saw_custom_lander"
SEGMENT_SENTINEL = "oh no... check logic"
PRE_BIRTHDAY_BEAR = "A. Pre_Birthday_Bear"
POST_BIRTHDAY_BEAR = "B. Post_Birthday_Bear"
PRE_CROSS_SELL = "A. Pre_Cross_Sell"
POST_CROSS_SELL = "B.Post_Cross_Sell"
PRE_PRODUCT_2 = "A. Pre_Product_2"
POST_PRODUCT_2 = "B. Post_Product_2"
PRODUCT_SENTINEL = "check logic"
PERIOD_SENTINEL = "Check logic"
MRFUZZY_LABEL = "mrfuzzy"
LOVEBEAR_LABEL = "lovebear"

# --- fixed values: constants -------------------------------------------------------------------
# conversion-rate lift of the landing-page test, applied to sessions since the test
INCREMENTAL_LIFT = "0.0087"

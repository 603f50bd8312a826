"""The built-in detection rules.

Fixed values: each line is a rule (id, name, category) followed by its signals
(vector, mode, pattern, weight, version pattern, version kind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FRONT, _META, _BACK, _CMS, _DATA = "Frontend Framework", "Meta-Framework & SSR Engine", "Backend Framework & Server", "CMS", "Database & ORM"
_TRACK, _CDN, _SAFE, _PAY, _FONT = "Analytics & Tracking", "CDN & Infrastructure", "Security & Authentication", "Payment Gateway", "Font Provider"
_LIB, _CSS, _DEV = "JS Library & UI Utilities", "CSS Framework & Component UI", "DevOps & Build Tools"
_THREE = r"(?<version>\d+\.\d+\.\d+)"
_TWO = r"(?<version>\d+\.\d+(?:\.\d+)?)"


def _script(pattern: str, weight: float, version: str | None = None) -> tuple:
    return ("scriptSrc", "regex", pattern, weight, version, "exact")


def _html(pattern: str, weight: float, version: str | None = None) -> tuple:
    return ("htmlRegex", "regex", pattern, weight, version, "exact")


def _global(pattern: str, weight: float) -> tuple:
    return ("jsGlobals", "global", pattern, weight, None, "exact")


def _marker(pattern: str, weight: float) -> tuple:
    return ("domElements", "marker", pattern, weight, None, "exact")


def _header(pattern: str, weight: float, version: str | None = None, kind: str = "exact") -> tuple:
    return ("headers", "header", pattern, weight, version, kind)


def _cookie(pattern: str, weight: float) -> tuple:
    return ("cookies", "cookie", pattern, weight, None, "exact")


def _generator(weight: float, version: str, kind: str = "exact") -> tuple:
    return ("meta", "metaKey", "generator", weight, version, kind)


RULES: tuple = (
    ("react", "React", _FRONT, (_global("React", 0.9), _html("data-reactroot|data-reactid", 0.6), _script(r"react(?:-dom)?(?:@|\.)[^/]*\.(?:production|development)?\.?min\.js|react@\d+", 0.75, "react@" + _THREE))),
    ("vuejs", "Vue.js", _FRONT, (_global("Vue", 0.9), _html("data-v-[0-9a-f]{6,}", 0.65), _script(r"vue(?:@|\.)?[^/]*\.(?:min\.)?js", 0.7, "vue@" + _THREE))),
    ("angular", "Angular", _FRONT, (_global("angular", 0.85), _html('ng-version="' + _THREE + '"', 0.7, 'ng-version="' + _THREE + '"'), _marker("ion-app", 0.5))),
    ("svelte", "Svelte", _FRONT, (_global("__svelte", 0.95), _html('svelte-[0-9a-z]{5,}|class="[^"]*svelte-', 0.65), _marker("[data-svelte]", 0.7))),
    ("solidjs", "SolidJS", _FRONT, (_global("__solid", 0.95), _marker("[data-solid]", 0.65))),
    ("alpinejs", "Alpine.js", _FRONT, (_global("Alpine", 0.9), _html("x-data=|x-init=|x-bind:", 0.6), _script(r"alpinejs|alpine(?:\.min)?\.js", 0.7))),
    ("nextjs", "Next.js", _META, (_global("__NEXT_DATA__", 1.0), _script("/_next/static/", 0.9), ("meta", "metaKey", "next-head-count", 0.85, None, "exact"), _header("x-nextjs-page", 0.8), _marker("#__next", 0.7), _html('id="__next"', 0.6))),
    ("nuxtjs", "Nuxt.js", _META, (_global("__NUXT__", 1.0), _html('id="__nuxt"|data-nuxt-', 0.7), _script("/_nuxt/", 0.85), _marker("#__nuxt", 0.7))),
    ("remix", "Remix", _META, (_global("__remixContext", 1.0), _script(r"remix\.run|/build/routes", 0.6))),
    ("astro", "Astro", _META, (_marker("astro-island", 0.9), _generator(0.9, "Astro v" + _THREE), _html("astro-island|astro-slot|data-astro-cid", 0.6))),
    ("gatsby", "Gatsby", _META, (_global("__GATSBY", 1.0), _generator(0.9, "Gatsby " + _THREE), _marker("#___gatsby", 0.7), _html('id="___gatsby"', 0.6))),
    ("sveltekit", "SvelteKit", _META, (_html("data-sveltekit-|__sveltekit", 0.8), _script("/_app/immutable/", 0.7))),
    ("express", "Express", _BACK, (_header("x-powered-by", 0.7, "Express", "major_only"),)),
    ("nextjs-server", "Next.js Server", _BACK, (_header("x-powered-by", 0.7, r"Next\.js " + _THREE),)),
    ("php", "PHP", _BACK, (_header("x-powered-by", 0.7, "PHP/" + _THREE), _cookie("PHPSESSID", 0.7))),
    ("aspnet", "ASP.NET", _BACK, (_header("x-aspnet-version", 0.8, _THREE), _header("x-powered-by", 0.6, r"ASP\.NET"), _cookie("ASP.NET_SessionId", 0.75))),
    ("wordpress", "WordPress", _CMS, (_generator(0.95, "WordPress " + _TWO), _script("/wp-content/|/wp-includes/", 0.85), _html("wp-content|wp-includes|wp-json", 0.6), _cookie("wordpress_", 0.7))),
    ("drupal", "Drupal", _CMS, (_generator(0.9, r"Drupal (?<version>\d+)", "major_only"), _script("/sites/(?:all|default)/|/core/misc/drupal", 0.8), _header("x-generator", 0.8, r"Drupal (?<version>\d+)", "major_only"))),
    ("ghost", "Ghost", _CMS, (_generator(0.95, "Ghost " + _TWO), _html("ghost-url|data-ghost", 0.6))),
    ("shopify", "Shopify", _CMS, (_marker("shopify-section", 0.85), _html(r"cdn\.shopify\.com|Shopify\.theme", 0.7), _script(r"cdn\.shopify\.com", 0.75), _header("x-shopify-stage", 0.7))),
    ("webflow", "Webflow", _CMS, (_generator(0.9, "Webflow"), _marker("[data-wf-page]", 0.85), _html(r"data-wf-page|data-wf-site|webflow\.js", 0.7))),
    ("wix", "Wix", _CMS, (_generator(0.9, r"Wix\.com"), _script(r"static\.parastorage\.com|wixstatic\.com", 0.85))),
    ("squarespace", "Squarespace", _CMS, (_generator(0.9, "Squarespace"), _html(r"static1\.squarespace\.com|squarespace-cdn", 0.8), _header("x-served-by", 0.5, "Squarespace"))),
    ("strapi", "Strapi", _CMS, (_header("x-powered-by", 0.7, "Strapi"), _html("strapi", 0.4))),
    ("supabase", "Supabase", _DATA, (_script(r"@supabase/supabase-js|supabase\.co", 0.85), _html(r"supabase\.co|supabase\.github\.io", 0.6))),
    ("firebase", "Firebase", _DATA, (_script(r"firebasejs/|gstatic\.com/firebasejs", 0.85, "firebasejs/" + _THREE), _html(r"firebase(?:app|js)?\.js|firebaseConfig", 0.6))),
    ("graphql", "GraphQL", _DATA, (("networkRequests", "regex", "/graphql", 0.6, None, "exact"), _html("graphql", 0.4))),
    ("google-analytics", "Google Analytics", _TRACK, (_script(r"googletagmanager\.com/gtag/js|google-analytics\.com/analytics\.js", 0.9), _cookie("_ga", 0.7), _html(r"gtag\(|ga\('create'|GoogleAnalyticsObject", 0.65), ("networkRequests", "regex", r"google-analytics\.com/g/collect|analytics\.google\.com", 0.75, None, "exact"))),
    ("google-tag-manager", "Google Tag Manager", _TRACK, (_script(r"googletagmanager\.com/gtm\.js", 0.9), _html(r"googletagmanager\.com/ns\.html|gtm\.start", 0.7))),
    ("hotjar", "Hotjar", _TRACK, (_script(r"static\.hotjar\.com|hotjar\.js", 0.9), _html(r"hj\(|hotjar", 0.5))),
    ("posthog", "PostHog", _TRACK, (_script(r"posthog|us\.i\.posthog\.com|app\.posthog\.com", 0.9), _html("posthog", 0.5))),
    ("plausible", "Plausible", _TRACK, (_script(r"plausible\.io/js", 0.95), _html("plausible", 0.5))),
    ("mixpanel", "Mixpanel", _TRACK, (_script(r"cdn\.mxpanel\.com|mixpanel", 0.9), _html("mixpanel", 0.5))),
    ("segment", "Segment", _TRACK, (_script(r"cdn\.segment\.com/analytics\.js", 0.95),)),
    ("cloudflare", "Cloudflare", _CDN, (_header("cf-ray", 0.85), _header("server", 0.7, "cloudflare"), _header("cf-cache-status", 0.75), _cookie("__cf", 0.6))),
    ("vercel", "Vercel", _CDN, (_header("server", 0.8, "Vercel"), _header("x-vercel-id", 0.85), _header("x-vercel-cache", 0.8))),
    ("netlify", "Netlify", _CDN, (_header("server", 0.75, "Netlify"), _header("x-nf-request-id", 0.8))),
    ("fastly", "Fastly", _CDN, (_header("x-served-by", 0.5, "cache-"), _header("x-fastly-request-id", 0.8))),
    ("cloudfront", "AWS CloudFront", _CDN, (_header("x-amz-cf-id", 0.85), _header("via", 0.5, "CloudFront"))),
    ("auth0", "Auth0", _SAFE, (_script(r"cdn\.auth0\.com|auth0\.min\.js", 0.9), _html("auth0", 0.4))),
    ("clerk", "Clerk", _SAFE, (_script(r"clerk\.(?:com|dev|accounts\.dev)", 0.9), _html(r"clerk\.js|__clerk", 0.6))),
    ("recaptcha", "reCAPTCHA", _SAFE, (_script(r"google\.com/recaptcha|gstatic\.com/recaptcha", 0.9), _html("g-recaptcha|grecaptcha", 0.7))),
    ("turnstile", "Cloudflare Turnstile", _SAFE, (_script(r"challenges\.cloudflare\.com/turnstile", 0.95), _html("cf-turnstile", 0.8))),
    ("stripe", "Stripe", _PAY, (_script(r"js\.stripe\.com", 0.95), _html("stripe", 0.4))),
    ("paypal", "PayPal", _PAY, (_script(r"paypal(?:objects|\.com/sdk)", 0.9), _html("paypal", 0.4))),
    ("google-fonts", "Google Fonts", _FONT, (_script(r"fonts\.googleapis\.com|fonts\.gstatic\.com", 0.85), _html(r"fonts\.googleapis\.com|fonts\.gstatic\.com", 0.7))),
    ("font-awesome", "Font Awesome", _FONT, (_script("fontawesome|font-awesome", 0.8), _html("font-?awesome|fa-", 0.4))),
    ("adobe-fonts", "Adobe Fonts", _FONT, (_script(r"use\.typekit\.net|typekit", 0.9),)),
    ("jquery", "jQuery", _LIB, (_global("jQuery", 0.85), _script(r"jquery[-.](?:\d+\.)*\d+(?:\.min)?\.js", 0.8, "jquery-" + _THREE))),
    ("lodash", "Lodash", _LIB, (_global("_", 0.5), _script(r"lodash(?:\.min)?\.js|lodash@", 0.85, "lodash@" + _THREE))),
    ("axios", "Axios", _LIB, (_script(r"axios(?:@|\.min|\.)", 0.85, "axios@" + _THREE),)),
    ("gsap", "GSAP", _LIB, (_global("gsap", 0.85), _script(r"gsap(?:\.min)?\.js|cdnjs.*gsap", 0.8, "gsap/" + _THREE))),
    ("chartjs", "Chart.js", _LIB, (_global("Chart", 0.7), _script(r"chart(?:\.min)?\.js|chart\.js", 0.85))),
    ("d3", "D3.js", _LIB, (_global("d3", 0.85), _script(r"d3(?:@|\.v?\d|\.min)", 0.8, "d3@" + _THREE))),
    ("swiper", "Swiper", _LIB, (_global("Swiper", 0.85), _html('swiper-container|swiper-wrapper|class="swiper', 0.6), _script("swiper", 0.7))),
    (
        "tailwind-css",
        "Tailwind CSS",
        _CSS,
        (
            ("cssClasses", "regex", r"\b(flex|grid|hidden|block|inline-block|relative|absolute|sticky|items-center|justify-between|min-h-screen|max-w-\w+|px-\d+|py-\d+|space-[xy]-\d+)\b", 0.55, None, "exact"),
            _html(r'class="[^"]*\b(sm:|md:|lg:|xl:|2xl:|hover:|focus:|dark:)[^"]*"', 0.7),
        ),
    ),
    ("bootstrap", "Bootstrap", _CSS, (_script(r"bootstrap(?:\.bundle)?(?:\.min)?\.js|bootstrap@", 0.8, "bootstrap@" + _THREE), _html(r'class="[^"]*\b(container|row|col-(?:sm|md|lg|xl)-\d+|navbar|btn-primary)\b', 0.6))),
    ("mui", "MUI (Material-UI)", _CSS, (_html(r'class="[^"]*\b(Mui[A-Z]\w+|makeStyles-|jss\d+)\b', 0.8), _script("@mui|@material-ui", 0.7))),
    ("chakra-ui", "Chakra UI", _CSS, (_html(r'class="[^"]*\bchakra-', 0.8), _script("@chakra-ui", 0.7))),
    ("ant-design", "Ant Design", _CSS, (_html(r'class="[^"]*\bant-(?:btn|layout|menu|table|form)', 0.8), _script("antd|ant-design", 0.7))),
    ("bulma", "Bulma", _CSS, (_script("bulma", 0.8), _html(r'class="[^"]*\b(is-primary|is-large|navbar-brand|hero-body)\b', 0.5))),
    ("styled-components", "Styled-Components", _CSS, (_html(r'data-styled(?:-components)?|class="[^"]*\bsc-[0-9a-zA-Z]+', 0.8), _script("styled-components", 0.7))),
    ("emotion", "Emotion", _CSS, (_html(r'data-emotion|class="[^"]*\bcss-[0-9a-z]+', 0.75), _script("@emotion", 0.7))),
    ("vite", "Vite", _DEV, (_script(r"/@vite/|/node_modules/\.vite/|vite/dist/client", 0.85), _html(r'type="module"[^>]*src="/src/main\.|/@vite/client', 0.6))),
    ("webpack", "Webpack", _DEV, (_html("webpackJsonp|__webpack_require__|webpackChunk", 0.7), _script(r"webpack-runtime|\.chunk\.js", 0.5))),
    ("turbopack", "Turbopack", _DEV, (_script(r"/_next/static/chunks/.*\.js.*turbopack|static/chunks/turbopack", 0.7),)),
)

SCHEMA = "rule_id string, name string, category string, vector string, mode string, pattern string, weight double, version_regex string, version_kind string, signal_seq int"


def rule_rows(rules: tuple = RULES) -> list[tuple]:
    """One row per signal, in order."""
    flat = [(r[0], r[1], r[2], *s) for r in rules for s in r[3]]
    return [(*row, i) for i, row in enumerate(flat)]


def builtin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), SCHEMA)

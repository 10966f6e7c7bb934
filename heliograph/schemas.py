"""Columns of the engine's tables, as DDL."""

EVENT = (
    "external_id string, occurred_on date, added_at timestamp, cameo_code string, cameo_root string, quad_class short, goldstein double, tone double, "
    "actor1_name string, actor1_country string, actor2_name string, actor2_country string, geo_type short, geo_name string, country string, adm1 string, "
    "lon double, lat double, num_mentions int, num_sources int, num_articles int, url string, props string"
)
MENTION = "event_id string, mentioned_at timestamp, source_name string"
ARTICLE = "gkg_id string, added_at timestamp, url string, site string, tone double, themes array<string>"
LOCATION = "gkg_id string, loc_type short, country string, adm1 string, lon double, lat double"
EDIT = "wiki string, server string, title string, at timestamp, user_hash string, bot boolean, created boolean, rev long"
POST = "op string, at timestamp, uri string, text string"
TABLES = {
    "source": "id int, kind string, name string, config string, enabled boolean, attention boolean, every_s long",
    "fetch_log": "source_id int, file string, fetched_at timestamp, rows_seen int, rows_kept int",
    "event": EVENT, "mention": MENTION, "gkg_article": ARTICLE, "gkg_location": LOCATION, "wiki_edit": EDIT,
    "mention_hourly": "event_id string, hour timestamp, mentions long, sources long",
    "attention_hourly": "region_kind string, region string, hour timestamp, events long, mentions long, sources long",
    "attention_daily": "region_kind string, region string, day date, events long, mentions long, sources long",
    "attention_anomaly": "region_kind string, region string, hour timestamp, mentions long, baseline_mean double, baseline_sd double, z double, computed_at timestamp",
    "region_name": "region_kind string, region string, name string",
    "story": "url string, title string, site string, status string, attempts int, fetched_at timestamp, first_seen timestamp",
    "country_shape": "fips string, name string, geom array<array<array<struct<x: double, y: double>>>>",
    "theme_daily": "region_kind string, region string, theme string, day date, articles long",
    "theme_hourly": "region string, theme string, hour timestamp, articles long",
    "firms_detection": "satellite string, lat double, lon double, acq_at timestamp, frp double, confidence string, daynight string, bright_ti4 double, fire_id string",
    "fire": "event_id string, hull array<struct<x: double, y: double>>, detections long, high_conf long, frp_sum double, frp_max double, first_seen timestamp, last_seen timestamp",
    "country_code": "iso2 string, iso3 string, fips string, name string",
    "wiki_activity": "wiki string, title string, hour timestamp, edits long, editors long, created boolean",
    "wiki_page": "wiki string, title string, lon double, lat double, country string, checked_at timestamp",
    "gazetteer_place": "id long, kind string, name string, alternates string, iso2 string, admin1 string, lon double, lat double, population long",
    "chatter_5min": "source string, place_id long, bucket timestamp, posts long",
    "chatter_hourly": "source string, place_id long, hour timestamp, posts long",
    "bsky_uri": "uri string, place_id long, at timestamp",
    "conflict_forecast": "run string, country string, month date, fatalities double, p_any double",
    "state_outlet": "country string, name string, typology string, trajectory array<string>",
    "state_outlet_id": "country string, name string, kind string, value string, origin string",
    "tg_post": "handle string, post_id long, posted_at timestamp, text string, views long, forward string, links array<string>, media array<string>",
    "yt_video": "video_id string, title string, published timestamp, views long, length_s long, description string, keywords array<string>, status string",
}

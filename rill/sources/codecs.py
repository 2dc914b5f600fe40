"""Fixed-width layouts of the ad pipeline's messages, for the `fixedwidth` source. Names, kinds, widths."""

#: event_time in milliseconds; type is 1 for clicks and 2 for views.
LAYOUTS = {
    "event": "event_time L, event_type c9, ad_id c37, userid_pageid_ipaddress c82",
    "filtered": "event_time L, ad_id c37",
    "joined": "event_time L, c_id c37",
    "partial": "max_event_time L, c_id L, count i",
    "full": "wid L, c_id L, count i, latency i",
    "full_typed": "wid L, c_id L, count i, event_time L, type i",
    "window_partial": "max_event_time L, count L",
    "header": "window_start_time L, numerator i, denominator i",
}

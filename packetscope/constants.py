"""Column layouts, header aliases, lookup tables and rule lists.

Everything here is data that has to agree with the capture files and reports
users already have. No logic lives in this module.
"""

# --- fixed values: CSV layouts -------------------------------------------------

BASIC_COLUMNS = [
    "timestamp", "source_mac", "destination_mac", "source_ip", "destination_ip",
    "source_port", "destination_port", "protocol", "length", "ttl", "tcp_flags",
    "tcp_window", "icmp_type", "icmp_code", "dns_query", "http_method", "http_host",
    "http_path", "packet_direction",
]

DETAILED_COLUMNS = [
    "#", "Time", "Source MAC", "Destination MAC", "Source IP", "Destination IP",
    "Protocol", "Source Port", "Destination Port", "Length", "TTL", "TCP Flags",
    "UDP Length", "UDP Checksum", "HTTP Method", "HTTP Host", "HTTP Path", "HTTP Status",
    "DNS ID", "DNS QR", "DNS Opcode", "DNS QName", "DNS QType", "DNS AnsName",
    "DNS AnsRData", "DNS AnsType", "ICMP Type", "ICMP Code", "ARP Opcode", "ARP HW Src",
    "ARP IP Src", "ARP HW Dst", "ARP IP Dst", "DHCP Msg Type", "SNMP Community",
    "SNMP PDU Type", "SNMP ReqID", "SNMP OID", "SNMP Value", "TLS Content Type",
    "TLS Version", "TLS Handshake Type",
]

RAW_COLUMNS = [
    "timestamp", "source_mac", "dest_mac", "source_ip", "dest_ip", "protocol", "length",
    "source_port", "destination_port", "tcp_flags", "packet_direction", "ttl",
    "identification",
]

TSHARK_COLUMNS = [
    "frame.time_epoch", "eth.src", "eth.dst", "ip.src", "ip.dst", "ip.proto", "frame.len",
    "tcp.srcport", "tcp.dstport", "tcp.flags", "ip.ttl", "ip.id",
]

SAVED_COLUMNS = [
    "timestamp", "source_mac", "destination_mac", "source_ip", "destination_ip",
    "protocol", "length", "source_port", "destination_port", "ttl", "tcp_flags",
    "tcp_window", "icmp_type", "icmp_code", "dns_query", "http_method", "http_host",
    "http_path", "packet_direction", "raw_data",
]

# A header holding any of these is the detailed layout.
DETAILED_MARKERS = ["HTTP Method", "DNS QName", "TLS Content Type"]

# Text that stands for "no value" in one layout or another.
SENTINELS = ["", "N/A", "None"]

# --- fixed values: header aliases, first match wins ------------------------------
# The tail of a list (after the usual spellings) holds the names our own writers
# and the packet-dissector field export use.

ALIASES = {
    "timestamp": ["timestamp", "time", "Timestamp", "Time"],
    "src_mac": ["source_mac", "src_mac", "source mac", "Source MAC", "source_MAC", "eth.src"],
    "dst_mac": ["destination_mac", "dst_mac", "destination mac", "Destination MAC",
                "destination_MAC", "dest_mac", "eth.dst"],
    "src_ip": ["source_ip", "src_ip", "source ip", "Source IP", "src_IP", "ip.src"],
    "dst_ip": ["destination_ip", "dst_ip", "destination ip", "Destination IP", "dst_IP",
               "dest_ip", "ip.dst"],
    "src_port": ["source_port", "src_port", "source port", "Source Port", "tcp.srcport"],
    "dst_port": ["destination_port", "dst_port", "destination port", "Destination Port",
                 "tcp.dstport"],
    "protocol": ["protocol", "Protocol", "proto", "Proto"],
    "length": ["length", "len", "size", "Length", "Size", "frame.len"],
    "ttl": ["ttl", "time to live", "TTL", "Time to Live", "ip.ttl"],
    "tcp_flags": ["tcp_flags", "flags", "TCP Flags", "Flags"],
    "tcp_window": ["tcp_window", "window", "TCP Window", "Window Size"],
    "icmp_type": ["icmp_type", "ICMP Type", "icmp type"],
    "icmp_code": ["icmp_code", "ICMP Code", "icmp code"],
    "dns_query": ["dns_query", "DNS Query", "dns query", "query", "DNS QName"],
    "http_method": ["http_method", "HTTP Method", "http method", "method"],
    "http_host": ["http_host", "HTTP Host", "http host", "host"],
    "http_path": ["http_path", "HTTP Path", "http path", "path"],
    "packet_direction": ["packet_direction", "direction", "Direction"],
    "raw_data": ["raw_data", "raw", "Raw Data", "Raw"],
    # carried by single layouts only
    "time_epoch": ["frame.time_epoch"],
    "tcp_flags_hex": ["tcp.flags"],
    "ip_proto": ["ip.proto"],
    "identification": ["identification", "ip.id"],
    "packet_no": ["#"],
    "udp_length": ["UDP Length"],
    "udp_checksum": ["UDP Checksum"],
    "http_status": ["HTTP Status"],
    "dns_id": ["DNS ID"],
    "dns_qr": ["DNS QR"],
    "dns_opcode": ["DNS Opcode"],
    "dns_qtype": ["DNS QType"],
    "dns_ans_name": ["DNS AnsName"],
    "dns_ans_rdata": ["DNS AnsRData"],
    "dns_ans_type": ["DNS AnsType"],
    "arp_opcode": ["ARP Opcode"],
    "arp_src_mac": ["ARP HW Src"],
    "arp_src_ip": ["ARP IP Src"],
    "arp_dst_mac": ["ARP HW Dst"],
    "arp_dst_ip": ["ARP IP Dst"],
    "dhcp_type": ["DHCP Msg Type"],
    "snmp_community": ["SNMP Community"],
    "snmp_pdu": ["SNMP PDU Type"],
    "snmp_request_id": ["SNMP ReqID"],
    "snmp_oid": ["SNMP OID"],
    "snmp_value": ["SNMP Value"],
    "tls_content_type": ["TLS Content Type"],
    "tls_version_text": ["TLS Version"],
    "tls_handshake_type": ["TLS Handshake Type"],
}

# --- fixed values: rule lists ----------------------------------------------------

SUSPICIOUS_PORTS = [22, 23, 25, 135, 445, 1433, 3306, 3389, 5900, 8080, 8888]
MALWARE_DOMAINS = ["malware.com", "badsite.com", "evil.net", "attacker.org"]
SUSPICIOUS_PATHS = ["/admin", "/wp-login", "/shell", "/cmd", "/exec", "/phpmyadmin"]
SUSPICIOUS_TLDS = [".xyz", ".top", ".pw", ".cc", ".tk"]
SUSPICIOUS_FLAG_TEXT = ["RST+ACK", "FIN+RST", "SYN+FIN"]
PROBE_PORTS = [0, 1, 21, 22, 23, 25, 53, 1080, 1337, 4444, 6667, 6668, 6669, 8080, 8888,
               9001, 9002, 12345, 31337]
EICAR_MARKER = "EICAR-STANDARD-ANTIVIRUS-TEST-FILE"

HTTP_PORTS = [80, 8080]
TLS_PORTS = [443, 8443]
DNS_PORTS = [53]
DHCP_PORTS = [67, 68]
SNMP_PORTS = [161, 162]
HTTP_LINE_MARKS = ["GET ", "POST ", "PUT ", "DELETE ", "HTTP/"]

# TCP control bits, lowest first.
TCP_BITS = [("FIN", 1), ("SYN", 2), ("RST", 4), ("PSH", 8), ("ACK", 16), ("URG", 32),
            ("ECE", 64), ("CWR", 128)]

# --- fixed values: lookup tables ---------------------------------------------------

DHCP_TYPES = [(1, "DISCOVER"), (2, "OFFER"), (3, "REQUEST"), (4, "DECLINE"), (5, "ACK"),
              (6, "NAK"), (7, "RELEASE"), (8, "INFORM")]

SNMP_PDUS = [(0, "GetRequest"), (1, "GetNextRequest"), (2, "GetResponse"),
             (3, "SetRequest"), (4, "Trap"), (5, "GetBulkRequest"), (6, "InformRequest"),
             (7, "SNMPv2-Trap"), (8, "Report")]

ARP_OPCODES = [(1, "request"), (2, "reply")]

# (type, code) -> meaning; code None means "any other code of that type".
ICMP_MEANINGS = [
    (0, None, "echo_reply"),
    (3, None, "unreachable"),
    (3, 0, "network_unreachable"),
    (3, 1, "host_unreachable"),
    (3, 3, "port_unreachable"),
    (8, None, "echo_request"),
    (11, None, "time_exceeded"),
]

PROTOCOL_FAMILIES = [
    ("TCP", "Transmission Control Protocol"),
    ("UDP", "User Datagram Protocol"),
    ("ICMP", "Internet Control Message Protocol"),
    ("DNS", "Domain Name System"),
    ("HTTP", "Hypertext Transfer Protocol"),
    ("HTTPS", "HTTP Secure"),
    ("ARP", "Address Resolution Protocol"),
]

PORT_SERVICES = [
    (20, "FTP data transfer"),
    (21, "File transfers (FTP control)"),
    (22, "Secure remote access (SSH)"),
    (23, "Telnet (insecure remote access)"),
    (25, "Email sending (SMTP)"),
    (53, "Domain name lookup (DNS)"),
    (67, "DHCP server (IP address assignment)"),
    (68, "DHCP client (IP address request)"),
    (80, "Web browsing (HTTP)"),
    (110, "Email receiving (POP3)"),
    (123, "Network time synchronization (NTP)"),
    (143, "Email access (IMAP)"),
    (161, "Network management (SNMP)"),
    (443, "Secure web browsing (HTTPS)"),
    (465, "Secure email sending (SMTPS)"),
    (500, "Internet Security Association (IPsec)"),
    (587, "Email submission"),
    (993, "Secure email receiving (IMAPS)"),
    (995, "Secure POP3 (POP3S)"),
    (1194, "VPN (OpenVPN)"),
    (1433, "Database (Microsoft SQL Server)"),
    (1723, "VPN (PPTP)"),
    (3306, "Database (MySQL)"),
    (3389, "Remote desktop (RDP)"),
    (5060, "Voice over IP (SIP)"),
    (5432, "Database (PostgreSQL)"),
    (8080, "Alternative web/proxy server"),
    (8443, "Alternative secure web server"),
    (27017, "Database (MongoDB)"),
]

# Names shown for the usual protocol numbers instead of the long description.
PROTOCOL_SHORT_NAMES = [
    (0, "HOPOPT (IPv6 Hop-by-Hop Option)"),
    (1, "ICMP"),
    (2, "IGMP"),
    (6, "TCP"),
    (17, "UDP"),
    (47, "GRE"),
    (50, "ESP"),
    (51, "AH"),
    (58, "IPv6-ICMP"),
    (89, "OSPF"),
    (132, "SCTP"),
    (2054, "ARP"),
]

# Assigned protocol numbers with description and defining document.
PROTOCOL_DESCRIPTIONS = [
    (0, "HOPOPT (IPv6 Hop-by-Hop Option) - RFC 8200"),
    (1, "ICMP (Internet Control Message Protocol) - RFC 792"),
    (2, "IGMP (Internet Group Management Protocol) - RFC 1112"),
    (3, "GGP (Gateway-to-Gateway Protocol) - RFC 823"),
    (4, "IP-in-IP (IP in IP Encapsulation) - RFC 2003"),
    (5, "ST (Internet Stream Protocol) - RFC 1190, RFC 1819"),
    (6, "TCP (Transmission Control Protocol) - RFC 793"),
    (7, "CBT (Core-based trees) - RFC 2189"),
    (8, "EGP (Exterior Gateway Protocol) - RFC 888"),
    (9, "IGP (Interior Gateway Protocol) - No specific RFC"),
    (10, "BBN-RCC-MON (BBN RCC Monitoring) - No RFC"),
    (11, "NVP-II (Network Voice Protocol) - RFC 741"),
    (12, "PUP (Xerox PUP) - No RFC"),
    (13, "ARGUS (ARGUS) - No RFC"),
    (14, "EMCON (EMCON) - No RFC"),
    (15, "XNET (Cross Net Debugger) - IEN 158"),
    (16, "CHAOS (Chaos) - No RFC"),
    (17, "UDP (User Datagram Protocol) - RFC 768"),
    (18, "MUX (Multiplexing) - IEN 90"),
    (19, "DCN-MEAS (DCN Measurement Subsystems) - No RFC"),
    (20, "HMP (Host Monitoring Protocol) - RFC 869"),
    (21, "PRM (Packet Radio Measurement) - No RFC"),
    (22, "XNS-IDP (XEROX NS IDP) - No RFC"),
    (23, "TRUNK-1 (Trunk-1) - No RFC"),
    (24, "TRUNK-2 (Trunk-2) - No RFC"),
    (25, "LEAF-1 (Leaf-1) - No RFC"),
    (26, "LEAF-2 (Leaf-2) - No RFC"),
    (27, "RDP (Reliable Data Protocol) - RFC 908"),
    (28, "IRTP (Internet Reliable Transaction Protocol) - RFC 938"),
    (29, "ISO-TP4 (ISO Transport Protocol Class 4) - RFC 905"),
    (30, "NETBLT (Bulk Data Transfer Protocol) - RFC 998"),
    (31, "MFE-NSP (MFE Network Services Protocol) - No RFC"),
    (32, "MERIT-INP (MERIT Internodal Protocol) - No RFC"),
    (33, "DCCP (Datagram Congestion Control Protocol) - RFC 4340"),
    (34, "3PC (Third Party Connect Protocol) - No RFC"),
    (35, "IDPR (Inter-Domain Policy Routing Protocol) - RFC 1479"),
    (36, "XTP (Xpress Transport Protocol) - No RFC"),
    (37, "DDP (Datagram Delivery Protocol) - No RFC"),
    (38, "IDPR-CMTP (IDPR Control Message Transport Protocol) - No RFC"),
    (39, "TP++ (TP++ Transport Protocol) - No RFC"),
    (40, "IL (IL Transport Protocol) - No RFC"),
    (41, "IPv6 (IPv6 Encapsulation) - RFC 2473"),
    (42, "SDRP (Source Demand Routing Protocol) - RFC 1940"),
    (43, "IPv6-Route (Routing Header for IPv6) - RFC 8200"),
    (44, "IPv6-Frag (Fragment Header for IPv6) - RFC 8200"),
    (45, "IDRP (Inter-Domain Routing Protocol) - No RFC"),
    (46, "RSVP (Resource Reservation Protocol) - RFC 2205"),
    (47, "GRE (Generic Routing Encapsulation) - RFC 2784, RFC 2890"),
    (48, "DSR (Dynamic Source Routing Protocol) - RFC 4728"),
    (49, "BNA (Burroughs Network Architecture) - No RFC"),
    (50, "ESP (Encapsulating Security Payload) - RFC 4303"),
    (51, "AH (Authentication Header) - RFC 4302"),
    (52, "I-NLSP (Integrated Net Layer Security Protocol) - TUBA"),
    (53, "SwIPe (SwIPe) - RFC 5237"),
    (54, "NARP (NBMA Address Resolution Protocol) - RFC 1735"),
    (55, "MOBILE (IP Mobility - Min Encap) - RFC 2004"),
    (56, "TLSP (Transport Layer Security Protocol) - No RFC"),
    (57, "SKIP (Simple Key-Management for Internet Protocol) - RFC 2356"),
    (58, "IPv6-ICMP (ICMP for IPv6) - RFC 4443, RFC 4884"),
    (59, "IPv6-NoNxt (No Next Header for IPv6) - RFC 8200"),
    (60, "IPv6-Opts (Destination Options for IPv6) - RFC 8200"),
    (61, "Any host internal protocol - No RFC"),
    (62, "CFTP (CFTP) - No RFC"),
    (63, "Any local network - No RFC"),
    (64, "SAT-EXPAK (SATNET and Backroom EXPAK) - No RFC"),
    (65, "KRYPTOLAN (Kryptolan) - No RFC"),
    (66, "RVD (MIT Remote Virtual Disk Protocol) - No RFC"),
    (67, "IPPC (Internet Pluribus Packet Core) - No RFC"),
    (68, "Any distributed file system - No RFC"),
    (69, "SAT-MON (SATNET Monitoring) - No RFC"),
    (70, "VISA (VISA Protocol) - No RFC"),
    (71, "IPCU (Internet Packet Core Utility) - No RFC"),
    (72, "CPNX (Computer Protocol Network Executive) - No RFC"),
    (73, "CPHB (Computer Protocol Heart Beat) - No RFC"),
    (74, "WSN (Wang Span Network) - No RFC"),
    (75, "PVP (Packet Video Protocol) - No RFC"),
    (76, "BR-SAT-MON (Backroom SATNET Monitoring) - No RFC"),
    (77, "SUN-ND (SUN ND PROTOCOL-Temporary) - No RFC"),
    (78, "WB-MON (WIDEBAND Monitoring) - No RFC"),
    (79, "WB-EXPAK (WIDEBAND EXPAK) - No RFC"),
    (80, "ISO-IP (International Organization for Standardization Internet Protocol) - No RFC"),
    (81, "VMTP (Versatile Message Transaction Protocol) - RFC 1045"),
    (82, "SECURE-VMTP (Secure Versatile Message Transaction Protocol) - RFC 1045"),
    (83, "VINES (VINES) - No RFC"),
    (84, "TTP (Transaction Transport Protocol) - Obsoleted March 2023"),
    (85, "NSFNET-IGP (NSFNET-IGP) - No RFC"),
    (86, "DGP (Dissimilar Gateway Protocol) - No RFC"),
    (87, "TCF (TCF) - No RFC"),
    (88, "EIGRP (EIGRP) - Informational RFC 7868"),
    (89, "OSPF (Open Shortest Path First) - RFC 2328"),
    (90, "Sprite-RPC (Sprite RPC Protocol) - No RFC"),
    (91, "LARP (Locus Address Resolution Protocol) - No RFC"),
    (92, "MTP (Multicast Transport Protocol) - No RFC"),
    (93, "AX.25 (AX.25) - No RFC"),
    (94, "OS (KA9Q NOS compatible IP over IP tunneling) - No RFC"),
    (95, "MICP (Mobile Internetworking Control Protocol) - No RFC"),
    (96, "SCC-SP (Semaphore Communications Sec. Pro) - No RFC"),
    (97, "ETHERIP (Ethernet-within-IP Encapsulation) - RFC 3378"),
    (98, "ENCAP (Encapsulation Header) - RFC 1241"),
    (99, "Any private encryption scheme - No RFC"),
    (100, "GMTP (GMTP) - No RFC"),
    (101, "IFMP (Ipsilon Flow Management Protocol) - No RFC"),
    (102, "PNNI (PNNI over IP) - No RFC"),
    (103, "PIM (Protocol Independent Multicast) - No RFC"),
    (104, "ARIS (IBM's ARIS Protocol) - No RFC"),
    (105, "SCPS (Space Communications Protocol Standards) - SCPS-TP"),
    (106, "QNX (QNX) - No RFC"),
    (107, "A/N (Active Networks) - No RFC"),
    (108, "IPComp (IP Payload Compression Protocol) - RFC 3173"),
    (109, "SNP (Sitara Networks Protocol) - No RFC"),
    (110, "Compaq-Peer (Compaq Peer Protocol) - No RFC"),
    (111, "IPX-in-IP (IPX in IP) - No RFC"),
    (112, "VRRP (Virtual Router Redundancy Protocol) - RFC 5798"),
    (113, "PGM (PGM Reliable Transport Protocol) - RFC 3208"),
    (114, "Any 0-hop protocol - No RFC"),
    (115, "L2TP (Layer Two Tunneling Protocol Version 3) - RFC 3931"),
    (116, "DDX (D-II Data Exchange) - No RFC"),
    (117, "IATP (Interactive Agent Transfer Protocol) - No RFC"),
    (118, "STP (Schedule Transfer Protocol) - No RFC"),
    (119, "SRP (SpectraLink Radio Protocol) - No RFC"),
    (120, "UTI (Universal Transport Interface Protocol) - No RFC"),
    (121, "SMP (Simple Message Protocol) - No RFC"),
    (122, "SM (Simple Multicast Protocol) - No RFC"),
    (123, "PTP (Performance Transparency Protocol) - No RFC"),
    (124, "IS-IS over IPv4 (Intermediate System to Intermediate System) - RFC 1142 and RFC 1195"),
    (125, "FIRE (Flexible Intra-AS Routing Environment) - No RFC"),
    (126, "CRTP (Combat Radio Transport Protocol) - No RFC"),
    (127, "CRUDP (Combat Radio User Datagram) - No RFC"),
    (128, "SSCOPMCE (Service-Specific Connection-Oriented Protocol) - ITU-T Q.2111"),
    (129, "IPLT (No RFC)"),
    (130, "SPS (Secure Packet Shield) - No RFC"),
    (131, "PIPE (Private IP Encapsulation within IP) - No RFC"),
    (132, "SCTP (Stream Control Transmission Protocol) - RFC 4960"),
    (133, "FC (Fibre Channel) - No RFC"),
    (134, "RSVP-E2E-IGNORE (Reservation Protocol End-to-End Ignore) - RFC 3175"),
    (135, "Mobility Header (Mobility Extension Header for IPv6) - RFC 6275"),
    (136, "UDPLite (Lightweight User Datagram Protocol) - RFC 3828"),
    (137, "MPLS-in-IP (Multiprotocol Label Switching Encapsulated in IP) - RFC 4023, RFC 5332"),
    (138, "manet (MANET Protocols) - RFC 5498"),
    (139, "HIP (Host Identity Protocol) - RFC 5201"),
    (140, "Shim6 (Site Multihoming by IPv6 Intermediation) - RFC 5533"),
    (141, "WESP (Wrapped Encapsulating Security Payload) - RFC 5840"),
    (142, "ROHC (Robust Header Compression) - RFC 5856"),
    (143, "Ethernet (Segment Routing over IPv6) - RFC 8986"),
    (144, "AGGFRAG (AGGFRAG Encapsulation Payload for ESP) - RFC 9347"),
    (145, "NSH (Network Service Header) - draft-ietf-spring-nsh-sr"),
    (2054, "ARP (Address Resolution Protocol) - No RFC"),
]

# --- fixed values: feature tables, in stored order ---------------------------------

BASIC_FEATURES = [
    "protocol_str", "is_tcp", "is_udp", "is_icmp", "is_http_basic", "is_dns_basic",
    "is_arp_basic", "src_ip_is_private", "dst_ip_is_private", "src_port_suspicious",
    "dst_port_suspicious", "has_suspicious_flags", "has_syn_basic", "has_rst_basic",
    "has_fin_basic", "has_ack_basic", "is_inbound", "is_outbound", "packet_length",
    "is_large_packet", "ttl", "has_low_ttl_basic", "has_dns_query_basic",
    "has_suspicious_dns_query_basic", "has_http_method_basic",
    "has_suspicious_http_path_basic", "has_suspicious_http_host_basic",
]

BASIC_LABEL_RULES = [
    "src_port_suspicious", "dst_port_suspicious", "has_suspicious_flags",
    "has_suspicious_dns_query_basic", "has_suspicious_http_path_basic",
    "has_suspicious_http_host_basic",
]

DETAILED_FEATURES = [
    "protocol_str", "is_tcp", "is_udp", "is_icmp", "is_http", "is_dns", "is_tls", "is_snmp",
    "is_dhcp", "is_arp", "src_ip_is_private", "dst_ip_is_private", "src_port_suspicious",
    "dst_port_suspicious", "has_suspicious_flags", "has_syn", "has_rst", "has_fin",
    "has_ack", "has_psh", "has_urg", "ttl", "has_low_ttl", "has_http_method", "is_http_get",
    "is_http_post", "has_suspicious_http_path", "has_suspicious_http_host", "has_dns_query",
    "has_suspicious_dns_query", "is_icmp_scan", "has_tls_info", "has_obsolete_tls",
    "is_arp_request", "is_arp_reply", "packet_length", "is_large_packet", "udp_length_val",
    "http_status_client_error", "http_status_server_error", "dns_qtype_is_any",
    "tls_is_handshake", "tls_is_app_data", "tls_is_client_hello",
]

DETAILED_LABEL_RULES = [
    "src_port_suspicious", "dst_port_suspicious", "has_suspicious_flags",
    "has_suspicious_http_path", "has_suspicious_http_host", "has_suspicious_dns_query",
    "has_obsolete_tls", "is_icmp_scan", "dns_qtype_is_any", "tls_is_handshake",
    "tls_is_app_data", "tls_is_client_hello", "http_status_client_error",
    "http_status_server_error",
]

# --- fixed values: private address registry ------------------------------------------
# IPv4 ranges as (first, last) and the single addresses carved out of them.

PRIVATE_V4 = [
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
]
PUBLIC_V4_EXCEPTIONS = ["192.0.0.9", "192.0.0.10"]

# IPv6 networks as (prefix, bits); exceptions are public again.
PRIVATE_V6 = [
    ("::1", 128), ("::", 128), ("64:ff9b:1::", 48), ("100::", 64), ("2001::", 23),
    ("2001:db8::", 32), ("2002::", 16), ("fc00::", 7), ("fe80::", 10),
]
PUBLIC_V6_EXCEPTIONS = [
    ("2001:1::1", 128), ("2001:1::2", 128), ("2001:3::", 32), ("2001:4:112::", 48),
    ("2001:20::", 28), ("2001:30::", 28),
]
